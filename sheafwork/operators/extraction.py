"""Extraction quality, OCR text cleaning and layout aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import text as T


def ocr_noise_word(w: Column) -> Column:
    symbols = F.length(F.regexp_replace(w, r"[\p{L}\p{N}]", ""))
    mixed = w.rlike(r"\p{Nd}") & w.rlike(r"\p{L}")
    return F.when(F.length(w) <= 2, F.lit(False)).when(symbols / F.length(w) > 0.45, F.lit(True)).when(mixed, w.rlike(r"[A-Za-z][0-9]|[0-9][A-Za-z]")).otherwise(F.lit(False))


def quality_report(df: DataFrame, text: str, confidence: Column) -> DataFrame:
    """Adds word_count, noise_words, noise_ratio, label, confidence, preview, handwriting_experimental."""
    d = df.withColumn("_w", T.words(T.text_or_empty(F.col(text)))).withColumn("word_count", F.size("_w")).withColumn("noise_words", F.size(F.filter("_w", ocr_noise_word)))
    d = d.withColumn("noise_ratio", F.when(F.col("word_count") > 0, F.round(F.col("noise_words") / F.col("word_count"), 3)).otherwise(1.0)).withColumn("confidence", F.round(confidence.cast("double"), 3))
    r, n = F.col("noise_ratio"), F.col("word_count")
    label = F.when((confidence >= 0.85) & (r <= 0.08) & (n >= 20), "high").when((confidence >= 0.55) & (r <= 0.18) & (n >= 8), "medium").otherwise("low")
    return d.withColumn("label", label).withColumn("preview", F.array_join(F.slice("_w", 1, 80), " ")).withColumn("handwriting_experimental", (confidence < 0.6) & (r > 0.12)).drop("_w")


def ocr_clean_text(c: Column) -> Column:
    marks = F.translate(F.replace(T.text_or_empty(c), F.lit("\r"), F.lit("\n")), "•·", "--")
    return T.joined(F.filter(F.transform(T.lines(marks), T.collapse), lambda x: x != ""))


def direct_text(df: DataFrame, text: str = "text") -> DataFrame:
    """The text source: stripped text, source plain_text, confidence 1, quality, no tables."""
    d = df.withColumn("extracted", T.strip(T.text_or_empty(F.col(text)))).withColumn("source", F.lit("plain_text")).withColumn("table_count", F.lit(0))
    return quality_report(d, "extracted", F.lit(1.0))


def layout_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """OCR lines (bbox of points, text) in reading order: bands of 14 units by half-even rounding, then left."""
    y = F.array_min(F.transform("bbox", lambda p: p[1]))
    x = F.array_min(F.transform("bbox", lambda p: p[0]))
    rows = lines.where(T.strip(T.text_or_empty(F.col("text"))) != "").select(key, F.bround(y / 14).alias("band"), x.alias("x"), "seq", T.strip(F.col("text")).alias("t"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("band", "x", "seq", "t"))).alias("l")).select(key, T.joined(F.transform("l", lambda r: r["t"])).alias("text"))


def mean_confidence(df: DataFrame, score: str, key: str = "doc_id") -> DataFrame:
    """Mean of the scores that are numbers, to three places; 0 where there is none."""
    return df.groupBy(key).agg(F.coalesce(F.round(F.avg(F.expr(f"try_cast({score} AS double)")), 3), F.lit(0.0)).alias("confidence"))


def word_lines(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """OCR words to text: lines (block, par, line) in order of first word, words from left; mean confidence."""
    rows = words.where(T.strip(T.text_or_empty(F.col("text"))) != "")
    by_line = rows.groupBy(key, "block_num", "par_num", "line_num").agg(
        F.min("seq").alias("first"),
        F.array_sort(F.collect_list(F.struct("left", "seq", T.strip(F.col("text")).alias("t")))).alias("w"),
        F.sum(F.when(F.col("conf") >= 0, F.col("conf") / 100)).alias("total"),
        F.count(F.when(F.col("conf") >= 0, 1)).alias("n"),
    )
    line = F.struct("first", T.joined(F.transform("w", lambda x: x["t"]), " ").alias("t"))
    out = by_line.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("l"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return out.select(key, T.joined(F.transform("l", lambda x: x["t"])).alias("text"), F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n"), 3)).otherwise(0.55).alias("confidence"))


def pdf_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """PDF blocks to text: per page by (y0, x0), pages by a blank line; confidence 0.94, or 0.4 if empty."""
    full = blocks.withColumn("t", T.strip(T.text_or_empty(F.col("text"))))
    pages = full.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("y0", "x0", "t")))).alias("b"))
    page = F.struct("page", T.joined(F.transform("b", lambda x: x["t"])).alias("t"))
    out = pages.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("p"))
    text = ocr_clean_text(T.joined(F.transform("p", lambda x: x["t"]), "\n\n"))
    return out.select(key, text.alias("text")).withColumn("confidence", F.when(F.col("text") != "", 0.94).otherwise(0.4))


def scanned_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """OCR pages (page, text, confidence) to text with page marks; mean confidence, 0.25 without text."""
    rows = pages.withColumn("t", T.strip(T.text_or_empty(F.col("text"))))
    mark = F.when(F.col("t") != "", F.struct("page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("t")).alias("t")))
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(mark)).alias("p"), F.round(F.avg("confidence"), 3).alias("mean"))
    return out.select(key, T.joined(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"), F.when(F.size("p") > 0, F.col("mean")).otherwise(0.25).alias("confidence"))


def ocr_cascade(a_text: Column, a_conf: Column, b_text: Column, b_conf: Column, c_text: Column, c_conf: Column, use_b: bool = True) -> Column:
    """The first engine's result that is good enough: engine a at 0.50, b (if on) at 0.55, then c; else failure."""
    def got(t: Column, c: Column, name: str) -> Column:
        return F.struct(t.alias("text"), c.alias("confidence"), F.lit(name).alias("engine"))

    full = lambda t: F.coalesce(T.strip(t) != "", F.lit(False))
    out = F.when(full(a_text) & (a_conf >= 0.50), got(a_text, a_conf, "a"))
    if use_b:
        out = out.when(full(b_text) & (b_conf >= 0.55), got(b_text, b_conf, "b"))
    return out.when(full(c_text), got(c_text, c_conf, "c")).otherwise(got(F.lit(""), F.lit(0.0), "none"))
