"""Mixing sources to target weights (op 5).

Hash-random keys, a range sort within each source by key, distributed prefix sums of token counts,
and a cut at each source's exact budget, with whole epochs where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import WORD, unwrapped, wrapped

#: Key ranges of a source: the first hex digits of the key. A hot source spreads over 16**3 ranges.
RANGE_DIGITS = 3
#: No source (so no document) is repeated more often than this.
MAX_EPOCHS = 3


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target`` double.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A source's share of all sizes stops at
    ``max_epochs`` times its size; the excess goes to the others by weight until none is above. That
    is a water level: ordered by cap / weight, the sources below the level are a prefix. The windows
    run over one row per source, never over documents, in one task: some tens of bytes a source, so they
    bear some ten million sources. No size at all: every target is 0.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # The level, if this source were the first that isn't full; the first such source has the true one.
    laid = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    true_level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("lv")))).over(whole)["lv"]
    return laid.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(true_level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words taken, repeats counted).

    A null text has size 0, a null source is a source of its own, ties of keys go by doc_id, repeated
    rows are documents of their own, an empty table gives no rows, other columns are not read. The
    document at a source's cut gives its first words only, so a source takes floor(target) words.
    Keys are md5 of the id, so reruns agree.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))
    keyed = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    # Prefix sums in two steps: within a key range here, over ranges on one row per (source, range).
    per_range = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offsets = per_range.withColumn("before_range", F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_epochs)
    placed = (
        offsets.alias("o")
        .join(budget.alias("b"), F.col("o.source").eqNullSafe(F.col("b.source")))
        .select(F.col("o.source").alias("p_source"), F.col("range").alias("p_range"), "before_range", "source_size", "target")
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = local.join(placed, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before_range") - F.col("before")))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes it, the last part rounded to
    a whole document (or none), so that no text is cut. Rows of equal id and size share their parts; a
    document without words takes no room and stays once, except where its id is null."""
    taken = mix(docs).groupBy("doc_id", "size").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("n"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = wrapped(docs, F.col("doc_id").alias("own_id"), size.alias("own_size"))
    # Always a merge join, as the texts are the large side at any scale.
    out = rows.join(taken.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_size") == F.col("size")))
    times = F.when(F.col("own_size") == 0, F.lit(1)).otherwise(F.round(F.col("t") / (F.col("n") * F.col("own_size")))).cast("int")
    return unwrapped(out.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))), docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, source IS NULL, source LIMIT 1), 0.0) * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
