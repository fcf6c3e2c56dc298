"""Structure detection on two shapes: scalar predicates on a text or line, and a line table for what is sequential.

A line table has (doc_id, pos, line); windows run within a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions import vocab as V

PAGE_BREAK = r"\f|\n\s*---\s*page\s*\d+\s*---\s*\n"


def ends_with(c: Column, marks: str) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(m) for m in marks])


# ---- page noise ----


def noise_normalize(line: Column) -> Column:
    one = T.strip(T.replace(line, r"\s+", " "))
    return T.replace(T.replace(one, r"\bpage\s+\d+\b", "page", "i"), r"\b\d+\s*/\s*\d+\b", "page")


def noise_candidate(line: Column) -> Column:
    return (line != "") & (T.n_words(line) <= 12) & (T.has_any(line, V.NOISE_WORDS) | T.matches(line, r"\A\d+\z"))


def repeated_noise(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = 2) -> DataFrame:
    """(doc_id, noise, n, seen): edge lines of pages, normalized, that come ``least`` times; ``seen`` is their order."""
    pages = df.select(key, F.split(T.text_or_empty(F.col(text)), T.pattern(PAGE_BREAK, "i"), -1).alias("p")).where(F.size("p") > 1)
    edge = pages.select(key, F.posexplode("p").alias("page", "t")).select(key, "page", T.full_lines(F.col("t")).alias("l"))
    # The last three may be among the first three, which then count twice.
    both = F.concat(F.slice("l", 1, 3), F.slice("l", F.greatest(F.size("l") - 2, F.lit(1)), 3))
    rows = edge.select(key, "page", F.posexplode(both).alias("i", "line")).select(key, "page", "i", noise_normalize(F.col("line")).alias("noise")).where(noise_candidate(F.col("noise")))
    return rows.groupBy(key, "noise").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "i")).alias("seen")).where(F.col("n") >= least)


def remove_page_noise(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "cleaned_text") -> DataFrame:
    """Deletes repeated noise wherever it occurs, in the order it was seen; adds the text and the noise."""
    found = repeated_noise(df, text, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seen", "noise"))).alias("_n"))
    d = df.join(found, key, "left").withColumn("removed_noise", F.coalesce(F.transform("_n", lambda x: x["noise"]), F.array().cast("array<string>")))
    return d.withColumn(out, without_noise(F.col(text), F.col("removed_noise"))).drop("_n")


def noise_of(c: Column) -> Column:
    """``removed_noise`` of one text by itself: the same array, without a join."""
    def edges(p: Column, page: Column) -> Column:
        both = lambda l: F.concat(F.slice(l, 1, 3), F.slice(l, F.greatest(F.size(l) - 2, F.lit(1)), 3))
        return F.transform(T.let(T.full_lines(p), both), lambda x, i: F.struct(noise_normalize(x).alias("noise"), page.alias("page"), i.alias("i")))

    def repeated(rows: Column) -> Column:
        # Sorted by noise and place: the first of equal ones with another after it.
        same = lambda k, x: F.coalesce(F.get(rows, k)["noise"] == x["noise"], F.lit(False))
        first = F.filter(rows, lambda x, k: ~same(k - 1, x) & same(k + 1, x))
        return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["page"], x["i"], x["noise"]))), lambda x: x["noise"])

    def found(pages: Column) -> Column:
        rows = F.filter(F.flatten(F.transform(pages, edges)), lambda x: noise_candidate(x["noise"]))
        return F.when(F.size(pages) > 1, T.let(F.array_sort(rows), repeated)).otherwise(F.array().cast("array<string>"))

    return T.let(F.split(T.text_or_empty(c), T.pattern(PAGE_BREAK, "i"), -1), found)


def without_noise(c: Column, noise: Column) -> Column:
    """A text of several pages without the noise, in its order; others as they are."""
    quoted = lambda x: F.concat(F.lit("(?dUi)\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    gone = F.aggregate(noise, c, lambda acc, x: F.regexp_replace(acc, quoted(x), F.lit("")))
    tidy = T.strip(T.replace(gone, "\\n{3,}", "\n\n"))
    n_pages = F.size(F.split(T.text_or_empty(c), T.pattern(PAGE_BREAK, "i"), -1))
    return F.when(n_pages > 1, tidy).otherwise(T.text_or_empty(c))


# ---- lines ----


def inline_headings(c: Column) -> Column:
    one = T.replace(c, r"\s+((?:Chapter|Unit|Section)\s+\d+[:.\-]?\s+[A-Z][A-Za-z0-9 ,:&\-]{4,90})", "\n\n$1", "i")
    return T.strip(T.replace(one, r"\s+(\d+\.\s+[A-Z][A-Za-z ,:&\-]{8,80})(?=\s+[A-Z])", "\n\n$1"))


def title_of(first: Column) -> Column:
    """The first line where it is a title, else ''."""
    return T.let(T.strip(F.coalesce(first, F.lit(""))), _title)


def _title(first: Column) -> Column:
    lower = F.length(F.regexp_replace(first, r"[^\p{Ll}]", "")) / F.greatest(F.length(first), F.lit(1))
    fits = reduce(lambda a, b: a | b, [T.matches(first, p) for p in V.TITLE_PATTERNS])
    return F.when((T.n_words(first) <= 12) & ~ends_with(first, ".?!") & (lower <= 0.65) & fits, first).otherwise("")


def detect_title(c: Column) -> Column:
    return title_of(F.get(T.full_lines(c), F.lit(0)))


def valid_heading(line: Column) -> Column:
    return T.let(T.strip(line), _valid_heading)


def _valid_heading(c: Column) -> Column:
    low = F.lower(c)
    layout = T.matches(low, r"\A[1-5]\.") & T.has_any(low, V.LAYOUT_WORDS)
    return (c != "") & (T.n_words(c) <= 10) & (F.length(c) <= 80) & ~ends_with(c, ".,;:") & ~layout & ~T.has_any(low, V.HEADING_REJECTS) & ~T.matches(c, r"\d+\.\s*\d+")


def is_heading(line: Column) -> Column:
    # A long line is none; its length is told before any pattern runs.
    return (F.length(T.strip(line)) <= 80) & (T.matches(line, V.HEADING, "i") | T.matches(line, V.NUMBERED_HEADING)) & valid_heading(line)


def line_table(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, line) of the stripped lines that aren't blank."""
    # Not an inner explode, for which the plan would split each text twice: to count its lines, and to give them.
    return df.select(key, F.posexplode_outer(T.full_lines(T.text_or_empty(F.col(text)))).alias("pos", "line")).where("pos is not null")


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, section, heading, content): headings by number from 0, content lines in order. What precedes the first is dropped."""
    own = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("h", is_heading(F.col("line"))).withColumn("section", F.sum(F.col("h").cast("int")).over(own) - 1).where("section >= 0")
    parts = marked.groupBy(key, "section").agg(F.max(F.when(F.col("h"), F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line")))).alias("c"))
    return parts.select(key, F.col("section").cast("int").alias("section"), "heading", F.transform("c", lambda x: x["line"]).alias("content"))


def _grouped(rows: Column, starts: Column, one) -> Column:
    """``one(first, rest, number)`` of each run of rows, by the 0-based places where runs start; what precedes them is dropped."""
    def each(s: Column, k: Column) -> Column:
        return one(F.get(rows, s), F.slice(rows, s + 2, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s - 1), k)

    return F.transform(starts, each)


def _places(rows: Column, test) -> Column:
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def sections_of(lines: Column) -> Column:
    """``sections`` of the full lines of one text: array<struct(section, heading, content)>."""
    one = lambda first, rest, k: F.struct(k.alias("section"), first.alias("heading"), rest.alias("content"))
    return T.let(F.struct(lines.alias("l"), _places(lines, lambda x, i: is_heading(x)).alias("at")), lambda x: _grouped(x["l"], x["at"], one))


def is_question(line: Column) -> Column:
    head = F.lower(F.substring(line, 1, max(map(len, V.QUESTION_STARTS))))
    starts = T.let(head, lambda low: reduce(lambda a, b: a | b, [low.startswith(s) for s in V.QUESTION_STARTS]))
    return line.contains("?") | T.matches(line, r"\A(q\d+\.?|question\s+\d+)", "i") | starts


def is_bullet(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.startswith(b) for b in V.BULLETS])


# ---- items in running text ----

# The patterns of items and fields.
NUMBERED = rf"(?<!\d)(\d{{1,2}})\s+([A-Z][A-Za-z /&\-]{{3,60}})\s+[–-]\s+(.+?)(?=\s+{V.GUIDELINE}|\z)"
ROMAN_ITEM = rf"\b(?:{V.ROMAN})\.\s+[A-Z][A-Za-z’' /&\-]+"
KEY_VALUE = r"\b([A-Z][A-Z /-]{3,40})\s*:\s*([^:]{1,120})(?=\s+[A-Z][A-Z /-]{3,40}\s*:|\z)"


def _groups(c: Column, p: str, flags: str, names: list[str], tidy) -> Column:
    parts = [F.regexp_extract_all(c, F.lit(T.pattern(p, flags)), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    return F.transform(F.arrays_zip(*parts), tidy)


def numbered_items(c: Column) -> Column:
    """array<struct(number, title, text)>"""
    return _groups(c, NUMBERED, "s", ["number", "title", "text"], lambda x: F.struct(T.strip(x["number"]).alias("number"), T.strip(x["title"]).alias("title"), T.collapse(x["text"]).alias("text")))


def roman_items(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(T.pattern(ROMAN_ITEM)), F.lit(0)), T.strip)


def key_values(c: Column) -> Column:
    """array<struct(key, value)>; a greedy value takes the first words of a longer next key."""
    return _groups(c, KEY_VALUE, "", ["key", "value"], lambda x: F.struct(T.strip(x["key"]).alias("key"), T.collapse(x["value"]).alias("value")))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines; where there is one at most, its sentences of more than 8 words."""
    def found(x: Column) -> Column:
        long_ = F.transform(F.filter(T.sentences(x["c"]), lambda s: T.n_words(s) > 8), T.strip)
        return F.when(F.size(x["b"]) > 1, x["b"]).otherwise(long_)

    blocks = F.filter(F.transform(F.split(c, T.pattern(r"\n\s*\n"), -1), T.strip), lambda x: x != "")
    return T.let(F.struct(blocks.alias("b"), c.alias("c")), found)


# ---- tables ----


def looks_tabular(line: Column) -> Column:
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return (line != "") & ((pipes >= 2) | line.contains("\t") | (F.size(F.split(line, T.pattern(r"\s{2,}"), -1)) >= 3))


def strip_pipes(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\|+|\|+\z", "")


def row_cells(line: Column) -> Column:
    """The cells of a row, empty ones dropped; null for what is no row (a separator, or fewer than two cells)."""
    return T.let(strip_pipes(T.strip(line)), _row_cells)


def _row_cells(c: Column) -> Column:
    by = F.when(c.contains("|"), F.split(c, r"\|", -1)).when(c.contains("\t"), F.split(c, "\t", -1)).otherwise(F.split(c, T.pattern(r"\s{2,}"), -1))
    cells = F.filter(F.transform(by, T.strip), lambda x: x != "")
    return F.when((c != "") & ~c.rlike(r"\A[-:| ]+\z"), T.let(cells, lambda a: F.when(F.size(a) >= 2, a)))


def text_tables(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, table, rows): maximal runs of tabular lines with two usable rows or more, numbered from 0."""
    lines = df.select(key, F.posexplode(F.transform(T.lines(T.text_or_empty(F.col(text))), T.strip)).alias("pos", "line")).where(looks_tabular(F.col("line")))
    own = Window.partitionBy(key).orderBy("pos")
    runs = lines.withColumn("run", F.col("pos") - F.row_number().over(own)).withColumn("cells", row_cells(F.col("line"))).where("cells is not null")
    found = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("r")).where(F.size("r") >= 2)
    return found.withColumn("table", F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).select(key, "table", F.transform("r", lambda x: x["cells"]).alias("rows"))


def tables_of(c: Column) -> Column:
    """``text_tables`` of one text: array<struct(table, source, rows)>."""
    def rows_of(places: Column) -> Column:
        return F.filter(F.transform(places, lambda x, j: F.struct((x["i"] - j).alias("run"), row_cells(x["s"]).alias("cells"))), lambda x: x["cells"].isNotNull())

    def runs(rows: Column) -> Column:
        starts = _places(rows, lambda x, i: F.coalesce(F.get(rows, i - 1)["run"] != x["run"], F.lit(True)))
        one = lambda first, rest, k: F.concat(F.array(first["cells"]), F.transform(rest, lambda x: x["cells"]))
        found = F.filter(T.let(starts, lambda at: _grouped(rows, at, one)), lambda r: F.size(r) >= 2)
        return F.transform(found, lambda r, k: F.struct(k.alias("table"), F.lit("text_layout").alias("source"), r.alias("rows")))

    places = F.filter(F.transform(T.lines(T.text_or_empty(c)), lambda x, i: F.struct(T.strip(x).alias("s"), i.alias("i"))), lambda x: looks_tabular(x["s"]))
    return T.let(places, lambda p: T.let(rows_of(p), runs))


# ---- labels ----


def heuristic_label(c: Column) -> Column:
    low, out = F.lower(c), None
    for label, terms in V.LABEL_RULES:
        rule = T.has_any(low, terms)
        if label == "question answer":
            rule = rule | low.startswith("what") | low.startswith("why") | low.startswith("how")
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise("summary")


def section_labels(parsed: DataFrame, key: str = "doc_id", classifier=None) -> DataFrame:
    """(doc_id, source_index, label, score) of the first 8 sections, else of the first 6 paragraphs.

    parsed: sections (array of struct(heading, content array)) and paragraphs. ``classifier`` may be a
    pandas UDF of text to struct(label, score); without one the rules label, with score 0.
    """
    whole = F.transform(F.slice("sections", 1, 8), lambda s, i: F.struct(i.alias("i"), F.substring(T.strip(F.concat(s["heading"], F.lit(" "), F.array_join(s["content"], " "))), 1, 600).alias("t")))
    full = F.filter(whole, lambda x: x["t"] != "")
    other = F.transform(F.slice("paragraphs", 1, 6), lambda p, i: F.struct(i.alias("i"), F.substring(p, 1, 600).alias("t")))
    rows = parsed.select(key, F.explode(F.when(F.size(full) > 0, full).otherwise(other)).alias("x")).select(key, F.col("x.i").alias("source_index"), F.col("x.t").alias("t"))
    if classifier is not None:
        rows = rows.withColumn("_r", classifier("t"))
        return rows.select(key, "source_index", F.coalesce("_r.label", heuristic_label(F.col("t"))).alias("label"), F.round(F.coalesce("_r.score", F.lit(0.0)), 3).alias("score"))
    return rows.select(key, "source_index", heuristic_label(F.col("t")).alias("label"), F.lit(0.0).alias("score"))


# ---- the whole ----


def parse(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with title, sections, questions, bullets, items, fields, paragraphs, tables and counts.

    A document without lines gets the same fields, with parser_type null and counts 0.
    """
    d = df.select(key, F.col(text).alias("_raw")).withColumn("removed_noise", noise_of(F.col("_raw"))).withColumn("_c", without_noise(F.col("_raw"), F.col("removed_noise")))
    d = d.withColumn("_t", inline_headings(F.col("_c")))
    # All by each text itself: no join carries the texts.
    out = d.withColumn("_l", T.full_lines(F.col("_t"))).withColumn("sections", sections_of(F.col("_l"))).withColumn("tables", tables_of(F.col("_t")))
    empty = F.size("_l") == 0
    out = (
        out.withColumn("parser_type", F.when(~empty, "rule_based_text_parser"))
        .withColumn("title", title_of(F.when(~empty, F.element_at("_l", 1))))
        .withColumn("questions", F.filter("_l", is_question))
        .withColumn("bullets", F.filter("_l", is_bullet))
        .withColumn("numbered_items", numbered_items(F.col("_t")))
        .withColumn("roman_items", roman_items(F.col("_t")))
        .withColumn("key_value_fields", key_values(F.col("_t")))
        .withColumn("paragraphs", paragraphs(F.col("_t")))
    )
    counts = {"line_count": "_l", "section_count": "sections", "question_count": "questions", "bullet_count": "bullets", "numbered_item_count": "numbered_items", "roman_item_count": "roman_items", "key_value_count": "key_value_fields", "table_count": "tables", "paragraph_count": "paragraphs", "removed_noise_count": "removed_noise"}
    for name, of in counts.items():
        out = out.withColumn(name, F.size(of))
    return out.withColumn("text", F.col("_t")).withColumn("removed_noise", F.slice("removed_noise", 1, 10)).drop("_raw", "_c", "_t", "_l")


# ---- layout blocks ----


def layout_sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (doc_id, index, type, bbox, text) with text: section_id, section_type, bbox, content, word_count."""
    t = T.strip(T.text_or_empty(F.col("text")))
    return blocks.where(t != "").select(key, F.col("index").alias("section_id"), F.coalesce("type", F.lit("unknown")).alias("section_type"), "bbox", t.alias("content"), T.n_words(t).alias("word_count"))


def layout_tables(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of blocks whose type names a table, with two usable rows or more."""
    rows = F.filter(F.transform(T.lines(T.strip(T.text_or_empty(F.col("text")))), row_cells), lambda x: x.isNotNull())
    named = F.lower(F.coalesce("type", F.lit(""))).contains("table")
    return blocks.where(named).select(key, F.col("index").alias("table"), F.lit("layout_model").alias("source"), rows.alias("rows"), "bbox").where(F.size("rows") >= 2)


def layout_text(raw: Column) -> Column:
    """Flat text of a block's raw JSON: a string, a list of strings or of objects with text, or an object."""
    items = F.from_json(raw, "array<string>")
    each = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.text"), x))
    return T.strip(F.coalesce(F.when(raw.startswith("["), T.joined(each)), F.get_json_object(raw, "$.text"), F.get_json_object(raw, "$.html"), raw))


def merge_layout(parsed: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds layout_sections and layout tables, after the text tables; documents without blocks are unchanged."""
    secs = layout_sections(blocks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_id", "section_type", "bbox", "content", "word_count"))).alias("layout_sections"))
    tabs = layout_tables(blocks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table", "source", "rows"))).alias("_lt"))
    d = parsed.join(secs, key, "left").join(tabs, key, "left")
    d = d.withColumn("tables", F.when(F.col("_lt").isNull(), F.col("tables")).otherwise(F.concat("tables", "_lt"))).drop("_lt")
    return d.withColumn("table_count", F.size("tables")).withColumn("layout_block_count", F.coalesce(F.when(F.col("layout_sections").isNotNull(), F.size("layout_sections")), F.lit(0)))


def append_tables(parsed: DataFrame, extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables an extractor found (doc_id, table, rows) after the others, as source pdf_extractor; the count follows."""
    more = extracted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table", F.lit("pdf_extractor").alias("source"), "rows"))).alias("_et"))
    d = parsed.join(more, key, "left").withColumn("tables", F.when(F.col("_et").isNull(), F.col("tables")).otherwise(F.concat("tables", "_et"))).drop("_et")
    return d.withColumn("table_count", F.size("tables"))
