"""Near-duplicate embeddings by sharded HNSW graphs (op 2) and exact top-k search (op 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import Scratch, connected_components, parts, small_batches
from sheafwork.llm.hnsw import Graph

COSINE = 0.98
#: Vectors of a shard: a label is dealt to about SHARDS of them, within these sizes. Every vector of the
#: label queries every shard, so it travels SHARDS times, and more often only beyond SHARDS * MOST_ROWS.
SHARD_ROWS, MOST_ROWS, SHARDS = 4096, 262_144, 16
#: First beam, queries of a recall audit (as many of the shard itself), recall that it must reach.
BEAM, AUDITED, RECALL = 24, 128, 0.999
QUERIES = 256
#: Nodes of a task's forest before it is handed on.
FOREST = 100_000


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    d = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce((F.size(vector) > 0) & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _find(up: dict[int, int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column.to_pylist()]) if len(column) else np.empty((0, 0))


def _search(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, shard, query, id, copies, vector), a shard's own vectors (query 0) ahead of its queries."""
        state: dict = {"key": None}

        def out(links: dict[int, int], up: dict[int, int]) -> pa.RecordBatch:
            ids = list(up)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([links.get(i, 0) for i in ids], pa.int64()), pa.array([_find(up, i) for i in ids], pa.int64())], names=["id", "links", "root"])

        def start(key) -> None:
            state.update(key=key, ids=[], copies=[], rows=[], graph=None, wait=[])

        def ready(ids: np.ndarray, raw: np.ndarray) -> None:
            own = np.concatenate(state["rows"])
            state["ids"], state["copies"] = np.concatenate(state["ids"]), np.concatenate(state["copies"])
            state["raw"], state["norm"] = own, np.sqrt(np.einsum("nd,nd->n", own, own))
            unit = own / state["norm"][:, None]
            state["graph"], state["beam"] = Graph(unit), BEAM
            # Audit: queries from other shards, and rows of this one without their hits on themselves, against
            # all rows by plain products; a beam that misses links is widened.
            draw = np.random.default_rng(3)
            foreign = np.flatnonzero(~np.isin(ids, state["ids"]))
            foreign = foreign[draw.permutation(len(foreign))[:AUDITED]]
            some = draw.permutation(len(own))[:AUDITED]
            asked = np.concatenate([raw[foreign] / np.sqrt(np.einsum("nd,nd->n", raw[foreign], raw[foreign]))[:, None], unit[some]])
            true = asked @ unit.T >= least
            true[len(foreign) + np.arange(len(some)), some] = False
            while True:
                q, i = state["graph"].within(asked, least - 1e-9, state["beam"])
                got = int(true[q, i].sum())
                if got >= RECALL * true.sum() or state["beam"] >= len(own):
                    break
                state["beam"] *= 2
            audits.append((int(true.sum()), got))

        audits: list[tuple[int, int]] = []
        links: dict[int, int] = {}
        up: dict[int, int] = {}

        def ask(ids: np.ndarray, raw: np.ndarray) -> None:
            if state["graph"] is None:
                ready(ids, raw)
            norm = np.sqrt(np.einsum("nd,nd->n", raw, raw))
            for at in range(0, len(ids), QUERIES):
                part = slice(at, at + QUERIES)
                q, i = state["graph"].within(raw[part] / norm[part, None], least - 1e-9, state["beam"])
                q = q + at
                near = np.einsum("nd,nd->n", raw[q], state["raw"][i]) / (norm[q] * state["norm"][i]) >= least
                near &= ids[q] != state["ids"][i]
                for a, b, n in zip(ids[q[near]].tolist(), state["ids"][i[near]].tolist(), state["copies"][i[near]].tolist(), strict=True):
                    links[a] = links.get(a, 0) + n
                    up.setdefault(a, a)
                    up.setdefault(b, b)
                    x, y = _find(up, a), _find(up, b)
                    if x != y:
                        up[max(x, y)] = min(x, y)

        for b in batches:
            if not b.num_rows:
                continue
            key = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            kind = b.column(2).to_pylist()
            ids, copies = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(key):
                end = at
                while end < len(key) and key[end] == key[at] and kind[end] == kind[at]:
                    end += 1
                if key[at] != state["key"]:
                    start(key[at])
                rows = _matrix(b.column(5).slice(at, end - at))
                if kind[at] == 0:
                    state["ids"].append(ids[at:end])
                    state["copies"].append(copies[at:end])
                    state["rows"].append(rows)
                else:
                    ask(ids[at:end], rows)
                at = end
            if len(up) > FOREST:
                yield out(links, up)
                links.clear()
                up.clear()
        yield out(links, up)
        if audits:  # rows without an id: links that the audits knew, and of these those found
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(audits), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*audits, strict=True))], names=["id", "links", "root"])

    return run


def near_duplicates(table: DataFrame, scratch: Scratch, least: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", audit: list | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. ``audit`` gets (links known, links found) of the recall audits.

    A null label, and a vector that is null, empty, zero or has a null or non-finite component, links with
    nothing; so does one among vectors of other lengths. Equal vectors of a label are one node that counts
    its copies. Repeated rows count as vectors of their own. A null id isn't linked: its component is null,
    and it is kept. An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    sound = sound & F.exists("v", lambda x: x != 0)
    # Squares of extreme values would under- or overflow: these are scaled by a power of two, which is exact.
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    scale = F.when((most < 1e-100) | (most > 1e100), F.pow(F.lit(2.0), F.least(F.lit(1000), -F.floor(F.log2(most))))).otherwise(F.lit(1.0))
    # Two hashes name a node, so vectors needn't be joined on.
    name = F.when(sound, F.struct(F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", F.lit("second"), "label").alias("h2")))
    named = scratch.put(rows.withColumn("node", name).select("vec_id", "label", "node", F.when(F.col("node").isNotNull(), F.transform("v", lambda x: x.cast("double") * scale)).alias("v")))
    nodes = named.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.put(nodes.withColumn("group", F.concat_ws("/", F.size("v").cast("string"), "label")))
    n = F.count(F.lit(1))
    shards = nodes.groupBy("group").agg(F.ceil(n / F.least(F.lit(MOST_ROWS), F.greatest(F.lit(SHARD_ROWS), F.ceil(n / SHARDS)))).cast("int").alias("shards"))
    dealt = scratch.put(nodes.join(shards, "group"))
    cols = ["group", "shard", "query", "id", "copies", "v"]
    own = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("query", F.lit(0)).select(cols)
    asks = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("query", F.lit(1)).select(cols)
    met = own.unionByName(asks).repartition(parts(spark), "group", "shard").sortWithinPartitions("group", "shard", "query", "id")
    hits = scratch.put(met.mapInArrow(_search(least), "id long, links long, root long"))
    if audit is not None:
        audit.append(tuple(hits.where("id is null").agg(F.sum("links"), F.sum("root")).first()))
    links = hits.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(hits.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")), scratch)
    known = nodes.select("node", "id", "copies").join(links, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    known = scratch.put(known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    out = named.select("vec_id", "node").join(known, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    scratch.drop(nodes, dealt, hits)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


DEDUP_ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, p.y FROM r JOIN p ON r.t = p.x),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.s = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


#: Rows of a document-range block, and about those of a range of blocks, which one task holds.
BLOCK, RANGE_ROWS, LEAST_RANGE = 128, 65_536, 4096


def padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class BlockIndex:
    """A range of vectors as blocks: a forward index each, and each term's least and greatest weight."""

    def __init__(self, owns: np.ndarray, ids: np.ndarray, data: np.ndarray):
        at = range(0, len(ids), BLOCK)
        self.owns, self.ids, self.data = owns, ids, data
        self.blocks = [slice(i, i + BLOCK) for i in at]
        self.high = np.stack([data[b].max(0) for b in self.blocks])
        self.low = np.stack([data[b].min(0) for b in self.blocks])

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The best k of this range as (-score, id); ``own`` is left out.

        Blocks go in the order of their summed term maxima; the first whose bound is below the k-th score
        ends the search, as do all after it. A bound equal to it may hold a smaller id, so it is scored.
        """
        width = min(len(query), self.data.shape[1])
        q = query[:width]
        bound = np.where(q >= 0, self.high[:, :width] * q, self.low[:, :width] * q).sum(1)
        best: list[tuple[int, int]] = []
        for j in np.argsort(-bound, kind="stable"):
            if len(best) == k and bound[j] < -best[-1][0]:
                break
            b = self.blocks[j]
            score = self.data[b, :width] @ q
            if len(best) == k:
                live = np.flatnonzero(score >= -best[-1][0])
            else:
                live = np.arange(len(score))
            ids, owns = self.ids[b], self.owns[b]
            if len(live) > k + 1:  # all rows tied with the last place stay
                live = live[score[live] >= np.partition(score[live], -(k + 1))[-(k + 1)]]
            best = sorted(best + [(-int(score[i]), int(ids[i])) for i in live if owns[i] != own])[:k]
        return best


def top_k(table: DataFrame, scratch: Scratch, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query (ids divisible by ``every``): query_id, rank, vec_id, score of its k best other rows.

    Components are floor(scale * x) in double precision, scores are integer inner products; a shorter
    vector counts as padded with zeros. Ties go to the smaller id. Vectors that are null, empty or hold
    null or non-finite components, and null ids, take no part. Rows of one id are rows of their own: each
    is a candidate of all rows but itself, and each is asked, where the id is a query's (its rows of the
    result are as many as its rows of the table). Fewer candidates than k: all. An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    # A number of its own tells rows of one id apart.
    rows = scratch.put(rows.select(F.monotonically_increasing_id().alias("own"), "vec_id", "v"))
    size = rows.count()
    n = max(1, -(-size // RANGE_ROWS), min(parts(spark), -(-size // LEAST_RANGE)))
    # Rows that tie on the id may fall into different ranges, so no range grows with them.
    ranges = rows.repartitionByRange(n, "vec_id", "own").select(F.spark_partition_id().alias("range"), F.lit(0).alias("kind"), "own", "vec_id", "v")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    # Each range meets each of the stated queries once.
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("range"), F.lit(1).alias("kind"), "own", "vec_id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (range, kind, own, vec_id, v), a range's own (kind 0) ahead of its queries."""
        at, owns, ids, rows, index = None, [], [], [], None
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for r, kind, own, i, v in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4), strict=True):
                if r != at:
                    at, owns, ids, rows, index = r, [], [], [], None
                x = v.values.to_numpy()
                if kind == 0:
                    owns.append(own)
                    ids.append(i)
                    rows.append(x)
                elif ids:
                    index = index or BlockIndex(np.array(owns, np.int64), np.array(ids, np.int64), padded(rows))
                    out += [(own, i, d, -s) for s, d in index.top(x, own, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["own", "query_id", "vec_id", "score"])

    met = scratch.put(ranges).unionByName(asks).repartition(max(n, parts(spark)), "range").sortWithinPartitions("range", "kind", "vec_id")
    found = met.mapInArrow(meet, "own long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_ORACLE = r"""
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.own <> c.own),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
