"""Chunks of a parsed document, ranked under a budget, and their selection for a mode and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions import vocab as V

MAX_WORDS, MAX_CHUNKS = 220, 8


def split_words(c: Column, limit: int = MAX_WORDS) -> Column:
    """One part, line ends kept, where the words fit; else windows of ``limit`` words joined by spaces."""
    def parts(x: Column) -> Column:
        n = F.size(x["w"])
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(limit))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(x["w"], i + 1, F.lit(limit)), " "))
        return F.when(n > limit, cut).when(n > 0, F.array(T.strip(x["c"]))).otherwise(F.array().cast("array<string>"))

    return T.let(F.struct(T.words(c).alias("w"), c.alias("c")), parts)


def low_value(c: Column) -> Column:
    return T.let(T.strip(c), lambda t: (t == "") | T.has_any(t, V.LOW_VALUE_PHRASES) | (T.n_words(t) < 4))


def low_value_kv(key: Column, value: Column) -> Column:
    return T.has_any(F.concat(key, F.lit(" "), value), V.LOW_VALUE_KEYS)


def title_priority(title: Column) -> Column:
    return F.when(T.has_any(title, V.HIGH_TERMS), 90).when(T.has_any(title, V.MEDIUM_TERMS), 60).otherwise(50)


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(rows: Column) -> Column:
    """Header, separator, body; short rows are filled up with empty cells."""
    def made(full: Column) -> Column:
        return T.joined(F.concat(F.array(_row(F.element_at(full, 1)), _row(F.array_repeat(F.lit("---"), F.size(F.element_at(full, 1))))), F.transform(F.slice(full, 2, F.size(full)), _row)))

    def filled(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        return F.when(F.size(rows) > 0, T.let(F.transform(rows, lambda r: F.concat(F.transform(r, T.strip), F.array_repeat(F.lit(""), width - F.size(r)))), made)).otherwise("")

    return T.let(rows, filled)


def _chunk(kind: str, rank: int, title: Column, content: Column, index: Column, priority: Column) -> Column:
    return F.struct(F.lit(rank).alias("source_rank"), F.lit(kind).alias("chunk_type"), title.alias("title"), content.alias("content"), index.cast("string").alias("source_index"), priority.cast("int").alias("priority"))


def _parts(kind: str, rank: int, items: Column, title, content, index, priority, drop) -> Column:
    """Chunks of an array of items: those not dropped, each split by the word limit."""
    def each(x: Column, i: Column) -> Column:
        return F.transform(split_words(T.strip(content(x))), lambda p: _chunk(kind, rank, title(x, i), p, index(x, i), priority(x)))

    kept = F.transform(items, lambda x, i: F.when(~drop(x), each(x, i)))
    return F.flatten(F.filter(kept, lambda a: a.isNotNull()))


def plain_chunks(c: Column, limit: int = MAX_WORDS) -> Column:
    """Sentences gathered until they hold ``limit`` words or more; the rest is a chunk too.

    A fold over sentences that keeps counts, so a chunk's words aren't counted again with each sentence.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        now, n = F.concat(a["now"], F.array(s)), a["n"] + T.n_words(s)
        full = n >= limit
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(T.strip(F.array_join(now, " "))))).otherwise(a["done"]).alias("done"),
            F.when(full, none).otherwise(now).alias("now"),
            F.when(full, 0).otherwise(n).alias("n"),
        )

    return F.aggregate(T.sentences(c), start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(T.strip(F.array_join(a["now"], " "))))).otherwise(a["done"]))


def priority_union(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``chunks``: layout, numbered, roman, key-value, table and section chunks in that order; paragraphs
    only where there is none of these, plain text only where there is nothing else.
    """
    no = F.lit("")
    parts = []
    if "layout_sections" in parsed.columns:
        lay = F.coalesce("layout_sections", F.expr("filter(layout_sections, x -> false)"))
        parts.append(F.when(F.col("layout_sections").isNotNull(), _parts("layout_section", 0, lay, lambda x, i: x["section_type"], lambda x: x["content"], lambda x, i: x["section_id"], lambda x: F.lit(80), lambda x: low_value(x["content"]))))
    joined = lambda a, b: T.strip(F.concat(a, F.lit("\n"), b))
    parts.append(_parts("numbered_item", 1, F.col("numbered_items"), lambda x, i: x["title"], lambda x: joined(x["title"], x["text"]), lambda x, i: x["number"], lambda x: title_priority(x["title"]), lambda x: low_value(joined(x["title"], x["text"]))))
    parts.append(_parts("roman_item", 2, F.col("roman_items"), lambda x, i: no, lambda x: x, lambda x, i: i, lambda x: F.lit(55), low_value))
    pair = lambda x: F.concat(x["key"], F.lit(": "), x["value"])
    parts.append(_parts("key_value", 3, F.col("key_value_fields"), lambda x, i: x["key"], pair, lambda x, i: no, lambda x: title_priority(x["key"]), lambda x: low_value_kv(x["key"], x["value"])))
    parts.append(_parts("table", 4, F.col("tables"), lambda x, i: F.concat(F.lit("Table "), (i + 1).cast("string")), lambda x: table_markdown(x["rows"]), lambda x, i: i, lambda x: F.lit(95), lambda x: low_value(table_markdown(x["rows"]))))
    body = lambda x: joined(x["heading"], F.array_join(x["content"], " "))
    parts.append(_parts("section", 5, F.col("sections"), lambda x, i: x["heading"], body, lambda x, i: i, lambda x: title_priority(x["heading"]), lambda x: low_value(body(x))))
    none = F.array().cast("array<struct<source_rank:int,chunk_type:string,title:string,content:string,source_index:string,priority:int>>")
    d = parsed.withColumn("_s", F.concat(*[F.coalesce(p, none) for p in parts]))
    d = d.withColumn("_p", F.when(F.size("_s") == 0, _parts("paragraph", 6, F.col("paragraphs"), lambda x, i: no, lambda x: x, lambda x, i: i, lambda x: F.lit(40), low_value)))
    plain = F.transform(plain_chunks(F.col("text")), lambda p, i: _chunk("plain_text", 7, no, p, i, F.lit(30)))
    chunks = F.when(F.size("_s") > 0, F.col("_s")).when(F.size("_p") > 0, F.col("_p")).when(F.col("text") != "", plain).otherwise(none)
    return d.withColumn("chunks", chunks).drop("_s", "_p")


def chunk_table(chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, seq, chunk_type, title, content, source_index, priority, source_rank)"""
    # An inner explode would make the plan filter by the number of chunks, with all that makes them once more below.
    return chunked.select(key, F.posexplode_outer("chunks").alias("seq", "c")).where("seq is not null").select(key, "seq", "c.*")


def rank_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds rn: chunks of four words or more by priority, then by their order; others are dropped."""
    rows = chunks.where(T.n_words(T.strip(F.col("content"))) >= 4)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), "source_rank", "seq")))


def budget(plan: Column, most: int = MAX_CHUNKS) -> Column:
    p = F.lower(T.strip(plan))
    return F.when(p == "premium", max(most, 40)).when(p == "pro", max(most, 20)).otherwise(min(most, 8))


def top_chunks(ranked: DataFrame, most: int = MAX_CHUNKS, plan: str = "free", key: str = "doc_id") -> DataFrame:
    n = {"premium": max(most, 40), "pro": max(most, 20)}.get(plan.lower().strip(), min(most, 8))
    return ranked.where(F.col("rn") <= n)


def plan_strategy(pages: Column, n_words: Column, most: Column | int = MAX_CHUNKS, limit: int = MAX_WORDS) -> Column:
    return F.when((pages > 10) | (n_words > most * limit * 2), "hierarchical_summary").otherwise("single_pass_generation")


def boost_terms(mode: Column, task: Column) -> Column:
    """array of terms by mode and task, with each mode's default; a small literal lookup."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for (m, t), terms in V.BOOST.items():
        if t is not None:
            out = out.when((mode == m) & (task == t), F.array(*map(F.lit, terms)))
    for (m, t), terms in V.BOOST.items():
        if t is None and m != "general":
            out = out.when(mode == m, F.array(*map(F.lit, terms)))
    return out.otherwise(F.array(*map(F.lit, V.BOOST["general", None])))


def chunk_score(priority: Column, title: Column, content: Column, terms: Column) -> Column:
    low = F.lower(F.concat(title, F.lit(" "), content))
    return priority + 15 * F.size(F.filter(terms, lambda t: F.contains(low, t)))


def selected_count(limit_applied: Column, mode: Column, task: Column) -> Column:
    eight = F.lit(False)
    for m, tasks in V.EIGHT_CHUNK_TASKS.items():
        eight = eight | ((mode == m) & task.isin(tasks))
    return F.when(limit_applied | eight, 8).otherwise(6)


def select_chunks(ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of ranked chunks with mode, task and limit_applied: the selected ones with ``pick`` and score.

    Preferred types come first (whichever of them), then the score, then the rank so far.
    """
    preferred = F.when(F.col("mode") == "student", F.col("chunk_type").isin(V.PREFERRED["student"])).when(F.col("mode") == "professional", F.col("chunk_type").isin(V.PREFERRED["professional"])).otherwise(F.col("chunk_type").isin(V.PREFERRED["general"]))
    d = ranked.withColumn("score", chunk_score(F.col("priority"), F.col("title"), F.col("content"), boost_terms(F.col("mode"), F.col("task")))).withColumn("_p", preferred)
    d = d.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_p"), F.desc("score"), "rn")))
    return d.where(F.col("pick") <= selected_count(F.col("limit_applied"), F.col("mode"), F.col("task"))).drop("_p")
