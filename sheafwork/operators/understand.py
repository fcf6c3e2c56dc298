"""Input understanding: what kind of text or file this is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions import vocab as V


def _count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def looks_like_questions(c: Column) -> Column:
    """Two question marks, or three question words as substrings."""
    return (_count_char(c, "?") >= 2) | (T.hits(c, V.QUESTION_WORDS) >= 3)


def looks_like_meeting(c: Column) -> Column:
    return T.hits(c, V.MEETING_WORDS) >= 2


def analyze_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds input_type, extraction_strategy, confidence, word_count, line_count, has_questions."""
    c = T.strip(T.text_or_empty(F.col(text)))
    d = df.withColumn("_t", c).withColumn("word_count", T.n_words(F.col("_t"))).withColumn("line_count", F.size(T.lines(F.col("_t")))).withColumn("has_questions", looks_like_questions(F.col("_t")))
    kind = F.when(F.col("word_count") < 5, "very_short_text").when(F.col("has_questions"), "question_answer_or_exam_text").when(looks_like_meeting(F.col("_t")), "professional_notes").otherwise("general_text")
    d = d.withColumn("document_type", kind)
    sure = F.when(F.col("document_type") == "very_short_text", 0.75).when(F.col("document_type") == "question_answer_or_exam_text", 0.82).when(F.col("document_type") == "professional_notes", 0.78).otherwise(0.80)
    return d.withColumn("confidence", sure).withColumn("input_type", F.lit("plain_text")).drop("_t")


def guess_document_type(c: Column) -> Column:
    low = F.lower(T.strip(T.text_or_empty(c)))
    return (
        F.when(low == "", "unknown")
        .when(looks_like_questions(low), "question_answer_or_exam_material")
        .when(looks_like_meeting(low), "professional_or_meeting_notes")
        .when(T.has_any(low, V.STUDY_WORDS), "student_study_material")
        .when(T.has_any(low, V.BUSINESS_WORDS), "business_document")
        .otherwise("general_document")
    )


def classify_pdf(words: Column, images: Column) -> Column:
    """struct(document_type, extraction_strategy, confidence) of page statistics summed over a file."""
    digital, scanned = words > 80, images > 0
    return F.struct(
        F.when(digital, "digital_pdf").when(scanned, "scanned_pdf").otherwise("empty_or_low_text_pdf").alias("document_type"),
        F.when(digital, "pdf_text_extraction").when(scanned, "pdf_to_image_ocr").otherwise("ocr_fallback").alias("extraction_strategy"),
        F.when(digital, 0.9).when(scanned, 0.82).otherwise(0.55).alias("confidence"),
    )


def classify_image(ocr_text: Column, width: Column, height: Column) -> Column:
    """struct(document_type, extraction_strategy, confidence, ocr_word_count, aspect_ratio, sample_text)."""
    n = T.n_words(ocr_text)
    return F.struct(
        F.when(n > 30, "text_image").when(n > 5, "low_text_image").otherwise("unclear_image").alias("document_type"),
        F.when(n > 30, "image_ocr").when(n > 5, "enhanced_image_ocr").otherwise("image_preprocessing_then_ocr").alias("extraction_strategy"),
        F.when(n > 30, 0.82).when(n > 5, 0.65).otherwise(0.45).alias("confidence"),
        n.alias("ocr_word_count"),
        F.round(width / F.greatest(height, F.lit(1)), 2).alias("aspect_ratio"),
        F.substring(ocr_text, 1, 300).alias("sample_text"),
    )


def file_kind(path: Column) -> Column:
    """pdf, image, text or unsupported, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "webp", "bmp"), "image").when(ext == "txt", "text").otherwise("unsupported")


def extractor(strategy: Column) -> Column:
    """Which extractor a strategy leads to."""
    return F.when(strategy == "pdf_text_extraction", "pdf_text").when(strategy.isin("pdf_to_image_ocr", "ocr_fallback"), "scanned_pdf").when(strategy.isin("image_ocr", "enhanced_image_ocr", "image_preprocessing_then_ocr"), "image").otherwise("text")
