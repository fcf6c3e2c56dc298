"""Text cleanup and normalization: ordered chains of replacements. The order is part of what they mean."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions import vocab as V

# Fixed values: (pattern, replacement[, flags]) in order.
INPUT_RULES = [("[ \\t]+", " "), ("\\n{3,}", "\n\n"), ("[^\\S\\n]+", " "), (r"([^\w\s])\1{4,}", "$1")]
SPACE_RULES = [("[ ]{2,}", " ")]
BULLET_RULES = [("[•●○▪■]+", "-")]
DASH_RULES = [(r"^\s*[–—]\s+", "- ", "m")]
PUNCTUATION_RULES = [("([!?;:])([A-Za-z0-9])", "$1 $2"), (r"\.(?<!\d\.)([A-Za-z])", ". $1"), (",([A-Za-z])", ", $1")]
CASE_RULES = [("([a-z])([A-Z])", "$1 $2")]
REPEAT_RULES = [("([.,!?]){2,}", "$1")]
NEWLINE_RULES = [("[ ]{2,}", " "), ("\\n{3,}", "\n\n")]
NUMBER_RULES = [(r"\b(\d+)\.\s+(\d+)\b", "$1.$2"), (r"\b(\d{1,2})([A-Z][A-Za-z])", "$1 $2")]
MARKER_RULES = [(m, rf"\s+({re.escape(m)}\s*:)", "\n\n$1", "i") for m in V.DENSE_MARKERS]
GUIDELINE_RULES = [
    (rf"\s+({V.GUIDELINE})", "\n\n$1"),
    (rf"(?<=\.)\s*({V.GUIDELINE})", "\n\n$1"),
]
ROMAN_RULES = [(rf"\s+((?:{V.ROMAN})\.\s+[A-Z])", "\n$1")]
QUOTE_RULES = [("word'([A-Za-z])", "word '$1"), (r"'([A-Za-z]+)to\b", "'$1' to")]


def clean_input_text(c: Column) -> Column:
    return T.strip(T.replace_all(F.replace(T.text_or_empty(c), F.lit("\r"), F.lit("\n")), INPUT_RULES))


def basic_spacing(c: Column) -> Column:
    return T.replace_all(F.replace(F.replace(c, F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" ")), SPACE_RULES)


def bullet_norm(c: Column) -> Column:
    dashed = lambda x: F.when(x.contains("–") | x.contains("—"), T.replace_all(x, DASH_RULES)).otherwise(x)
    return T.let(T.replace_all(c, BULLET_RULES), dashed)


def is_page_noise(line: Column) -> Column:
    """Spaces around it don't count. (``lower`` would part an ``İ`` in two, so a line with one is no noise.)"""
    return T.matches(line, rf"\A\s*(?:{'|'.join(p.strip('^$') for p in V.PAGE_NOISE)})\s*\z", "i") & ~line.contains("İ")


def page_noise(c: Column) -> Column:
    return T.keep_lines(c, lambda x: ~is_page_noise(x))


def punct_spacing(c: Column) -> Column:
    return T.replace_all(c, PUNCTUATION_RULES)


def _merges(c: Column, table: dict[str, str]) -> Column:
    """Whole words, in whatever case, by the same with a space in it. (The word comes first in the pattern: edges are dear.)"""
    return T.replace_found(c, [(re.sub(r"\\", "", k), rf"{k}\b(?<=\b{k})", v, "i") for k, v in table.items()])


def ocr_merges(c: Column) -> Column:
    """Lower-Upper splits, then whole-word repairs. (A rule for ``the`` before a capital can't match after the split.)"""
    return _merges(T.replace_all(c, CASE_RULES), V.CLEANUP_MERGES)


def repeat_punct(c: Column) -> Column:
    return T.replace_all(c, REPEAT_RULES)


def newline_norm(c: Column) -> Column:
    return T.replace_all(c, NEWLINE_RULES)


CLEANUP = [("basic_spacing", basic_spacing), ("bullets", bullet_norm), ("page_noise", page_noise), ("punctuation", punct_spacing), ("ocr_merges", ocr_merges), ("repeated_punctuation", repeat_punct), ("newlines", newline_norm)]


def cleanup(df: DataFrame, text: str = "text", out: str = "cleaned_text") -> DataFrame:
    """All steps in order; adds the text, both lengths and the number of steps."""
    d = df.withColumn("_c", T.text_or_empty(F.col(text)))
    for _, step in CLEANUP:
        d = d.withColumn("_c", step(F.col("_c")))
    d = d.withColumn(out, T.strip(F.col("_c"))).drop("_c")
    return d.withColumn("original_length", F.length(T.text_or_empty(F.col(text)))).withColumn("cleaned_length", F.length(out)).withColumn("steps", F.array(*[F.lit(n) for n, _ in CLEANUP]))


def norm_merges(c: Column) -> Column:
    return _merges(c, V.NORMALIZER_MERGES)


def norm_case_merge(c: Column) -> Column:
    return T.replace_all(c, CASE_RULES)


def norm_numbers(c: Column) -> Column:
    return T.replace_all(c, NUMBER_RULES)


def dense_markers(c: Column) -> Column:
    return T.replace_all(T.replace_found(c, MARKER_RULES), GUIDELINE_RULES)


def roman_spacing(c: Column) -> Column:
    return T.replace_all(c, ROMAN_RULES)


def quote_spacing(c: Column) -> Column:
    return T.replace_all(c, QUOTE_RULES)


NORMALIZE = [
    ("punctuation_spacing", punct_spacing), ("common_ocr_merges", norm_merges), ("lower_upper_merge", norm_case_merge), ("number_spacing", norm_numbers),
    ("dense_document_marker_split", dense_markers), ("roman_list_spacing", roman_spacing), ("quote_spacing", quote_spacing), ("repeated_spaces", newline_norm),
]


def normalize(df: DataFrame, text: str = "text", out: str = "normalized_text") -> DataFrame:
    """All steps in order; adds the text, the names of the steps that changed it and whether any did."""
    d = df.withColumn("_0", T.text_or_empty(F.col(text)))
    for k, (_, step) in enumerate(NORMALIZE):
        d = d.withColumn(f"_{k + 1}", step(F.col(f"_{k}")))
    fixes = F.filter(F.array(*[F.when(F.col(f"_{k}") != F.col(f"_{k + 1}"), F.lit(n)) for k, (n, _) in enumerate(NORMALIZE)]), lambda x: x.isNotNull())
    d = d.withColumn(out, T.strip(F.col(f"_{len(NORMALIZE)}"))).withColumn("applied_fixes", fixes)
    return d.withColumn("normalization_applied", F.size("applied_fixes") > 0).drop(*[f"_{k}" for k in range(len(NORMALIZE) + 1)])
