"""MinHash near-dedup by an inverted join of signature coordinates (op 9).

1. Each document becomes its set of hashed 5-word shingles, and that a signature of ``COORDS`` minima.
   Documents of equal sets are one class from here on (its least id), so copies cost nothing.
2. Classes are posted under each (coordinate, value). A pair above the similarity shares at least
   ``MATCHES`` coordinates but for a chance of about 1e-6. Values that one class alone holds can't match
   (skipped), and of a class's m shared values only the m - MATCHES + 1 rarest are kept (prefix): two
   classes that match MATCHES times meet in both prefixes, as rarity is one global order.
3. In each posting list the least class is the pivot; every other member is held against it. Pairs with
   MATCHES equal coordinates are confirmed on their full sets and linked.
4. Lists whose members now are in one component are merged and done (skip). In the rest all members of
   different components meet in blocks, on signatures, so no link between components is lost; pairs
   inside a component need no link, as the result is components. A pair is counted in the first list
   that its documents share. Long lists, and those with a large component, make no pairs: documents that
   have one there are held against the list's lead component and one another, in blocks of sets, so a
   group of near copies makes rows by its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import Scratch, connected_components, small_batches, word_hashes

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDS, MATCHES = 48, 20
#: Members of a group of pairs that one copy of the pivot's set serves.
PIVOT_SHARE = 256
#: Members of a list or group that a block holds, and the size from which a component or list is large.
BLOCK, LARGE = 512, 64

_RANDOM = np.random.default_rng(20240229)
#: Odd multipliers: one for each place in a shingle, one for each coordinate.
PLACES = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURNS = _RANDOM.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of fewer words, the whole sequence as one."""
    words = text.lower().split()  # bytes: exactly A-Z and the contract's white space
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - SHINGLE + 1)
    s = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        s = s * PLACES[i] + h[i : i + n]
        s ^= s >> np.uint64(29)
    s *= PLACES[0]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The high halves of the least s * turn, by coordinate."""
    out = np.empty(COORDS, np.uint32)
    for k in range(COORDS):
        out[k] = (s * TURNS[k]).min() >> np.uint64(32)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, prints, sigs = [], [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            s = shingles(t or b"")
            n.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n", "print", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t or b"").tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, set) sorted so that the pivot's own row (b null) leads its group."""
    pivot, own = None, np.empty(0, np.uint64)
    for rows in batches:
        left, right = [], []
        for a, part, b, data in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            s = np.frombuffer(data, np.uint64)
            if b is None:
                pivot, own = (a, part), s
            elif pivot == (a, part):
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(s) - both):
                    left.append(a)
                    right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src", "dst"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (post, i, j, side, doc, c, lead, n, sig, mask) sorted by (post, i, j), a group a pair of blocks of a list.

    Out: (a, b, null) for documents to compare, and in lists with a lead component (a, null, lead) for
    each document, outside it, of a pair to compare.
    """
    key, group = None, []

    def pairs() -> tuple[set, set]:
        cols = list(zip(*group, strict=True))
        k, lead = key[0] >> 32, cols[3][0]
        side, doc, comp, n = (np.array(cols[c]) for c in (0, 1, 2, 4))
        sig, mask = np.array(cols[5], np.int32), np.array(cols[6], np.int64)
        x = np.flatnonzero(side == 0)
        y = x if key[1] == key[2] else np.flatnonzero(side == 1)
        small, tall = np.minimum(n[x][:, None], n[y][None]), np.maximum(n[x][:, None], n[y][None])
        open_ = (comp[x][:, None] != comp[y][None]) & (100 * small >= PERCENT * tall)
        if key[1] == key[2]:
            open_ &= np.triu(np.ones(open_.shape, bool), 1)
        if not open_.any():
            return set(), set()
        same = np.zeros(open_.shape, np.int16)
        for c in range(COORDS):
            eq = sig[x, c][:, None] == sig[y, c][None]
            same += eq
            if c < k:  # met in an earlier list
                open_ &= ~(eq & ((mask[x] >> c & 1) == 1)[:, None] & ((mask[y] >> c & 1) == 1)[None])
        r, c = np.nonzero(open_ & (same >= MATCHES))
        r, c = x[r], y[c]
        if lead is not None:
            some = np.unique(np.concatenate([r, c]))
            return set(), {(int(doc[i]), lead) for i in some if comp[i] != lead}
        return set(zip(np.minimum(doc[r], doc[c]).tolist(), np.maximum(doc[r], doc[c]).tolist(), strict=True)), set()

    def out() -> Iterator[pa.RecordBatch]:
        two, one = pairs() if len(group) > 1 else ((), ())
        rows = [(a, b, None) for a, b in two] + [(a, None, c) for a, c in one]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "c"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:3] != key:
                yield from out()
                key, group = row[:3], []
            group.append(row[3:])
    yield from out()


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, block, ask, doc, home, set) sorted: a block's members (ask 0), then the documents held against them.

    Out: for each of these a link to one member of each other component that it links with.
    """
    key, docs, homes, sets, every, owner = None, [], [], [], None, None
    for b in batches:
        left, right = [], []
        for c, block, ask, doc, home, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (c, block) != key:
                key, docs, homes, sets, every = (c, block), [], [], [], None
            s = np.frombuffer(data, np.uint64)
            if not ask:
                docs.append(doc)
                homes.append(home)
                sets.append(s)
                continue
            if not docs:
                continue
            if every is None:
                size = np.array([len(x) for x in sets])
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            at = np.minimum(np.searchsorted(s, every), len(s) - 1)
            both = np.bincount(owner[s[at] == every], minlength=len(docs))
            hit = np.flatnonzero(100 * both >= PERCENT * (len(s) + size - both))
            for i in {homes[h]: h for h in hit if homes[h] != home}.values():
                left.append(doc)
                right.append(docs[i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src", "dst"])


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Null or empty texts (or without words) have 0 shingles and link with nothing. Repeated rows give a
    row each; rows of one id are one node, so an id with two texts links them. A null id is never linked:
    its component is null and it is kept. An empty table gives no rows; other columns are not read.
    """
    # Merge joins throughout: Spark sizes a table by its compressed file and an exploded array as one value,
    # so by its own choice it would build all posts (48 rows a document) in the driver to broadcast them.
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = scratch.put(rows.mapInArrow(_sketch, "doc_id long, n long, print binary, sig array<int>"))
    named = sketch.where("doc_id is not null and print is not null")
    classes = scratch.put(named.groupBy("print").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    posts = classes.select("doc", F.posexplode("sig").alias("k", "v")).select("doc", F.expr("shiftleft(cast(k as bigint), 32) + (cast(v as bigint) & 4294967295)").alias("post"))
    common = posts.groupBy("post").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = posts.join(common.hint("merge"), "post")
    ranked = met.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "post"))).alias("p")).where(F.size("p") >= MATCHES)
    lists = scratch.put(ranked.select("doc", F.explode(F.expr(f"slice(p, 1, size(p) - {MATCHES - 1})")).alias("x")).select("x.post", "doc"))
    # What can't meet anything leaves before any set is made.
    some = scratch.put(lists.select("doc").distinct())
    picked = rows.where("doc_id is not null and text is not null").join(some.hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi")
    sets = scratch.put(picked.mapInArrow(_sets, "doc long, set binary"))
    meta = scratch.put(classes.join(some.hint("merge"), "doc", "left_semi").select("doc", "n", "sig"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that hold on signatures, lengths and full sets."""
        a, b = meta.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), meta.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
        fits = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (equal >= MATCHES)
        hopeful = scratch.put(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(fits).select("a", "b").distinct())
        part = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("members") / PIVOT_SHARE)))
        shares = scratch.put(hopeful.groupBy("a").agg(F.count(F.lit(1)).alias("members")))
        dealt = hopeful.join(shares.hint("merge"), "a").select("a", part.alias("part"), "b")
        members = dealt.join(sets.withColumnRenamed("doc", "b").hint("merge"), "b").select("a", "part", "b", "set")
        pivots = shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("members") / PIVOT_SHARE)) - 1)).alias("part")).join(sets.withColumnRenamed("doc", "a").hint("merge"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
        together = members.unionByName(pivots).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        out = scratch.put(together.mapInArrow(_confirm, "src long, dst long"))
        scratch.drop(hopeful, shares)
        return out

    pivot = lists.groupBy("post").agg(F.min("doc").alias("a"))
    first = linked(lists.join(pivot.hint("merge"), "post").where("a <> doc").select("a", F.col("doc").alias("b")).distinct())
    parts_ = scratch.put(connected_components(first, scratch))
    homes = scratch.put(some.join(parts_.hint("merge"), F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("c")))
    sizes = scratch.put(homes.groupBy("c").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LARGE).select(F.col("c").alias("l")))
    placed = scratch.put(homes.join(sizes.hint("merge"), F.col("c") == F.col("l"), "left").select("doc", "c", "l"))
    member = scratch.put(lists.join(placed.hint("merge"), "doc").select("post", "doc", "c", "l"))
    # A list with a large component, or a long one, has a lead: its members go to the lead's group, not into pairs.
    lead = F.coalesce(F.min("l"), F.when(F.count(F.lit(1)) >= LARGE, F.min("c")))
    mixed = member.groupBy("post").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("length"), lead.alias("lead"))
    mixed = scratch.put(mixed.where("lo < hi").select("post", F.ceil(F.col("length") / BLOCK).cast("int").alias("blocks"), "lead"))
    masks = lists.groupBy("doc").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(post, 32) as int)))").alias("mask"))
    known = scratch.put(meta.join(masks.hint("merge"), "doc").select("doc", "n", "sig", "mask"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = member.join(mixed.hint("merge"), "post").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("post", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc", "c", "lead")
    blocks = dealt.join(known.hint("merge"), "doc").select("post", "i", "j", "side", "doc", "c", "lead", "n", "sig", "mask")
    met = scratch.put(blocks.repartition("post", "i", "j").sortWithinPartitions("post", "i", "j").mapInArrow(_meet, "a long, b long, c long"))
    second = linked(met.where("b is not null").select("a", "b").distinct())
    # A lead's group is its component and the documents that met it; these are held against the whole group.
    asked = scratch.put(met.where("c is not null").select(F.col("c").alias("g"), F.col("a").alias("doc")).distinct())
    leads = asked.select("g").distinct()
    group = scratch.put(homes.join(leads.hint("merge"), F.col("c") == F.col("g"), "left_semi").select(F.col("c").alias("g"), "doc").unionByName(asked))
    n_blocks = scratch.put(group.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    held = group.join(n_blocks.hint("merge"), "g").select("g", own.alias("block"), F.lit(0).alias("ask"), "doc")
    asks = asked.join(n_blocks.hint("merge"), "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("ask"), "doc")
    full = held.unionByName(asks).join(homes.join(sets.hint("merge"), "doc").hint("merge"), "doc").select("g", "block", "ask", "doc", "c", "set")
    third = scratch.put(full.repartition("g", "block").sortWithinPartitions("g", "block", "ask").mapInArrow(_against, "src long, dst long"))
    # An id with several texts links their classes.
    several = named.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo < hi").select("doc_id")
    same_id = named.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "print").join(classes.select("print", "doc").hint("merge"), "print").select(F.col("doc_id").alias("src"), F.col("doc").alias("dst"))
    component = scratch.put(connected_components(first.unionByName(second).unionByName(third).unionByName(same_id), scratch))

    by_print = scratch.put(classes.join(component.hint("merge"), F.col("doc") == F.col("node"), "left").select("print", F.coalesce("component", "doc").alias("component")))
    found = sketch.select("doc_id", F.col("n").alias("n_shingles"), "print").join(by_print.hint("merge"), "print", "left")
    whole = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    scratch.drop(lists, some, sets, meta, parts_, homes, sizes, placed, member, mixed, known, met, first, second, third, classes, asked, group, n_blocks)
    return found.select("doc_id", "n_shingles", whole.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, b.y FROM r JOIN b ON r.u = b.x),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
