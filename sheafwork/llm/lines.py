"""Line dedup by winnowing (op 10), in DataFrame functions only.

Lines with words are hashed. A *gram* is the shortest run of lines from a line on with at least
``gram`` words; in every *window*, the shortest run with at least ``run`` words, the least gram (the first
of equal ones) is its fingerprint (Schleimer, Wilkerson, Aiken: "Winnowing", 2003, with lengths in words).
Only selected grams are posted, with their positions: a run of ``run`` words or more that two places share
holds a whole window, so both places post the same gram there. Positions are joined on the gram. Where it
meets another position, the match is extended from it to the windows that selected it, ahead (the
shortest run of ``run`` words from a line on) and behind (the shortest that ends with a line); equal windows
are verified by 128 bits of their own. Windows seen earlier are deleted; their union is each repeated
run, whole, since each line of a shared run lies in a window ahead or behind that the run holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import WORD, Scratch

#: Words of a run that is deleted where it comes again; words of a gram. 2 * GRAM <= RUN guarantees
#: that each gram of a window's first RUN - GRAM words ends inside the window.
RUN, GRAM = 50, 25
#: Parts that a fingerprint's posts, and a window's places, are dealt to, so that a hot one isn't one task's.
SALTS = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def posts(docs: DataFrame, run: int = RUN, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, g, at, windows): the selected grams with their positions and the windows that selected them."""
    line = F.transform(_lines(F.col(text)), lambda x, i: F.struct(F.regexp_count(x, F.lit(WORD)).alias("w"), F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).alias("t"), i.alias("pos")))
    hashed = F.transform(line, lambda x: F.struct(x["w"].alias("w"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("h2"), x["pos"].alias("pos")))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.filter(hashed, lambda x: x["w"] > 0).alias("l"))
    # One shuffle deals the texts; their lines stay where they are.
    lines = texts.groupBy("id", "hash").agg(F.first("l").alias("l")).select("id", "hash", F.inline("l"))
    own = Window.partitionBy("id", "hash")
    upto = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("after", F.sum(F.col("w").cast("long")).over(upto)).withColumn("before", F.col("after") - F.col("w"))
    # Words ahead of a line rise strictly, so ranges of them are runs of lines.
    ahead = own.orderBy("before")
    span, back = ahead.rangeBetween(0, run - 1), own.orderBy("after").rangeBetween(-(run - 1), 0)
    selected = (
        placed.withColumn("g", F.when(F.sum("w").over(ahead.rangeBetween(0, gram - 1)) >= gram, F.xxhash64(F.collect_list("h").over(ahead.rangeBetween(0, gram - 1)))))
        .withColumn("whole", F.sum("w").over(span) >= run)
        .withColumn("end", F.max("pos").over(span))
        .withColumn("k1", F.when(F.col("whole"), F.xxhash64(F.collect_list("h").over(span))))
        .withColumn("k2", F.when(F.col("whole"), F.xxhash64(F.collect_list("h2").over(span))))
        # The window's fingerprint: its least gram, which ends inside it, and where that is.
        .withColumn("fp", F.when(F.col("whole"), F.min(F.when(F.col("g").isNotNull(), F.struct("g", "pos"))).over(ahead.rangeBetween(0, run - gram))))
        .withColumn("b_whole", F.sum("w").over(back) >= run)
        .withColumn("b_start", F.min("pos").over(back))
        .withColumn("b1", F.when(F.col("b_whole"), F.xxhash64(F.collect_list("h").over(back))))
        .withColumn("b2", F.when(F.col("b_whole"), F.xxhash64(F.collect_list("h2").over(back))))
        # A window behind holds the window ahead from its first line, and shares that one's fingerprint.
        .withColumn("b_fp", F.when(F.col("b_whole"), F.first("fp").over(back)))
    )
    ways = F.array(
        F.struct(F.col("fp").alias("fp"), F.col("k1").alias("k1"), F.col("k2").alias("k2"), F.col("pos").alias("from"), F.col("end").alias("to")),
        F.struct(F.col("b_fp").alias("fp"), F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.col("b_start").alias("from"), F.col("pos").alias("to")),
    )
    windows = selected.select("id", "hash", F.inline(F.filter(ways, lambda x: x["fp"].isNotNull())))
    # A post is a selected position with the windows that selected it; the texts are dealt already.
    return windows.groupBy("id", "hash", F.col("fp.g").alias("g"), F.col("fp.pos").alias("at")).agg(F.collect_set(F.struct("k1", "k2", "from", "to")).alias("windows"))


def repeated_lines(docs: DataFrame, scratch: Scratch, run: int = RUN, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, gone): the 0-based numbers of the lines to delete, for texts that have some.

    A text is known by its id and hash; rows equal in both are one text. Order is by id (null last),
    hash, line.
    """
    posted = scratch.put(posts(docs, run, gram, key, text))
    salt = F.pmod(F.xxhash64("id", "hash"), F.lit(SALTS)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    shared = posted.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", every)
    met = posted.select("*", salt).join(shared.hint("merge"), ["g", "salt"], "left_semi").select("id", "hash", "g", "salt", F.inline("windows"))
    met = scratch.put(met)
    place = F.struct(F.col("id").isNull().alias("x"), F.col("id"), F.col("hash"), F.col("from"))
    same = ["g", "k1", "k2"]
    first = met.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select(*same, "first", every)
    later = met.join(first.hint("merge"), [*same, "salt"]).where(place > F.col("first"))
    gone = later.select("id", "hash", F.explode(F.sequence("from", "to")).alias("pos")).groupBy("id", "hash").agg(F.collect_set("pos").alias("gone"))
    out = scratch.put(gone)
    scratch.drop(posted, met)
    return out


def line_dedup(docs: DataFrame, scratch: Scratch, run: int = RUN, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rid of later repeated runs, and columns _n_lines and _n_removed.

    Null texts stay null (0 lines), empty texts stay (one line). Texts under ``run`` words can't hold a
    run and stay. Lines without words are kept and don't break a run, except inside a deleted run,
    where they go as well. Repeated rows (same id and text) are one text and get the same result; rows of
    one id but different texts are different texts. Extra columns pass through.
    """
    gone = repeated_lines(docs, scratch, run, gram, key, text)
    # The row travels as one struct, so no name of its own can clash.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("h"))
    # Always a merge join: what is broadcast on small inputs would be no measure of large ones.
    joined = rows.join(gone.hint("merge"), F.col("key").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")), "left")
    t = F.col("row")[text]
    lines = _lines(t)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), t).otherwise(F.element_at(F.transform(F.array(lines), lambda l: F.array_join(F.transform(kept, lambda i: F.element_at(l, i + 1)), "\n")), 1))
    n = F.when(t.isNull(), F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(*[(left if c == text else F.col("row")[c]).alias(c) for c in docs.columns], n.alias("_n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("_n_removed"))


ORACLE = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l0),
c AS (SELECT *, (sum(w) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS aft FROM l WHERE w > 0),
k AS (SELECT *, aft - w AS bef FROM c),
f AS (SELECT doc_id, pos, sum(w) OVER a AS fw, list(line) OVER a AS fk, max(pos) OVER a AS fend, sum(w) OVER b AS bw, list(line) OVER b AS bk, min(pos) OVER b AS bstart FROM k
  WINDOW a AS (PARTITION BY doc_id ORDER BY bef RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY aft RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ws AS (SELECT doc_id, array_to_string(fk, chr(10)) AS key, pos AS s, fend AS e FROM f WHERE fw >= 50 UNION ALL SELECT doc_id, array_to_string(bk, chr(10)), bstart, pos FROM f WHERE bw >= 50),
fs AS (SELECT key, min({'d': doc_id, 's': s}) AS first FROM ws GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS pos FROM ws JOIN fs USING (key) WHERE {'d': doc_id, 's': s} > first),
left_ AS (SELECT l0.doc_id, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS n FROM l0 ANTI JOIN gone ON l0.doc_id = gone.doc_id AND l0.pos = gone.pos GROUP BY l0.doc_id),
tot AS (SELECT doc_id, count(*) AS n FROM l0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(tot.n, 0)::BIGINT AS n_lines, (coalesce(tot.n, 0) - coalesce(left_.n, 0))::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_.t, '') END AS text
FROM documents d LEFT JOIN tot ON d.doc_id = tot.doc_id LEFT JOIN left_ ON d.doc_id = left_.doc_id
"""
