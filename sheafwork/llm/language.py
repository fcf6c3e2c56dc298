"""Language identification (op 6).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow the regularised
leader (FTRL-proximal, elastic net; McMahan et al., 2013), then temperature calibration on labelled rows
that training left aside. Document frequencies cover every learnable document; the weights are fitted on
a bounded sample of at most about ``PER_LANG`` labelled rows a language, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sheafwork.llm.common import Scratch, small_batches

#: Hash slots of the n-grams, and their orders.
BITS, ORDERS = 15, (1, 2, 3)
SLOTS = 1 << BITS
#: Bound of the labelled sample: rows a language (expected; rows are drawn by a hash of the id).
PER_LANG = 600
UNKNOWN = "und"
#: FTRL: learning rate, its smoothing, elastic net, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3
#: Share of the sample kept for calibration: one row in so many.
CALIBRATION = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text, or None where it has no letter.

    Case is folded; runs of anything but letters count as one space.
    """
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[c]
    if not alpha.any():
        return None
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # the first of each run of others
    keep[0] = True
    s = np.where(alpha, c, 32)[keep].astype(np.uint64)
    total = np.zeros(SLOTS, np.int64)
    h = np.zeros(len(s), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(s) < n:
            break
        h = h[: len(s) - n + 1] * _MIX + s[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            total += np.bincount(((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64), minlength=SLOTS)
    return total


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SLOTS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[slots]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.features(slots, n) @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = counts(text) if text else None
        if got is None or not self.languages:
            return UNKNOWN, 0.0
        slots = np.flatnonzero(got)
        p = softmax(self.logits(slots, got[slots]) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int) -> Model:
    """sample: (language, slots, counts), in a fixed order."""
    langs = sorted({s[0] for s in sample})
    at = {x: i for i, x in enumerate(langs)}
    model = Model(langs, np.log((1.0 + n_docs) / (1.0 + df)) + 1.0, np.zeros((SLOTS, len(langs)), np.float64), np.zeros(len(langs)))
    if not langs:
        return model
    order = np.random.default_rng(7).permutation(len(sample))
    fit = [sample[i] for k, i in enumerate(order) if k % CALIBRATION or len(sample) < 2 * CALIBRATION]
    aside = [sample[i] for k, i in enumerate(order) if k % CALIBRATION == 0] if len(sample) >= 2 * CALIBRATION else []
    rows = [(at[x], np.append(s, SLOTS), np.append(model.features(s, c), 1.0)) for x, s, c in fit]  # the last slot is the bias
    z, n = np.zeros((SLOTS + 1, len(langs))), np.zeros((SLOTS + 1, len(langs)))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, s, x in rows:
            zs, ns = z[s], n[s]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            g2 = g * g
            z[s] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / ALPHA * w
            n[s] = ns + g2
    w = weights(z, n)
    model.weights, model.bias = w[:SLOTS].astype(np.float32), w[SLOTS]
    if aside:
        logits = [(at[x], model.logits(s, c)) for x, s, c in aside]

        # Laplace-smoothed targets: rows without an error don't prove that there are none.
        slip = 1.0 / (len(logits) + 2)

        def loss(t: float) -> float:
            p = [np.maximum(softmax(z / t), 1e-12) for _, z in logits]
            return -sum((1 - slip) * np.log(q[y]) + slip * np.log(q).mean() for q, (y, _) in zip(p, logits, strict=True))

        model.temperature = float(min(np.geomspace(0.02, 20, 121), key=loss))
    return model


def held_out(key: Column) -> Column:
    """The fold that nothing is learned from; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return train([], np.zeros(SLOTS), 0)
    draw = {x: min(1.0, PER_LANG / n) for x, n in sizes.items()}
    rows = known.select(F.col(key).cast("string").alias("id"), (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003).alias("u"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sampled rows' counts, and for each partition one row (lang null) of document frequencies."""
        df, n = np.zeros(SLOTS, np.int64), 0
        names = ["id", "lang", "n", "data"]
        for b in batches:
            out: list[tuple] = []
            for i, u, x, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = counts(t)
                if got is None:
                    continue
                slots = np.flatnonzero(got)
                df[slots] += 1
                n += 1
                if u < draw[x]:
                    out.append((i, x, len(slots), slots.astype("<i4").tobytes() + got[slots].astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([n], pa.int64()), pa.array([df.astype("<i8").tobytes()], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n += k
                df += np.frombuffer(d, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.astype("<i8").tobytes()], pa.binary())], names=["n", "data"])

    got = scratch.put(rows.mapInArrow(gather, "id string, lang string, n long, data binary"))
    sums = got.where("lang is null").select("n", "data").repartition(8).mapInArrow(add, "n long, data binary").collect()
    df, n_docs = sum((np.frombuffer(r["data"], "<i8") for r in sums), np.zeros(SLOTS, np.int64)), sum(r["n"] for r in sums)
    sample = []
    for r in got.where("lang is not null").orderBy("id", "lang", "n", "data").collect():  # about PER_LANG rows a language
        both = np.frombuffer(r["data"], "<i4")
        sample.append((r["lang"], both[: r["n"]].astype(np.int64), both[r["n"] :].astype(np.float64)))
    scratch.drop(got)
    return train(sample, df.astype(float), n_docs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with _lang_pred and _score. Null texts and those without a letter are ``und`` with score 0.

    Extra columns pass through; repeated rows are predicted each.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    fields = StructType([*docs.schema.fields, StructField("_lang_pred", StringType()), StructField("_score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "_lang_pred", "_score"])

    return docs.mapInArrow(predict, fields)


def language_id(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Predictions see the text alone.

    An empty table gives no rows; without learnable rows every prediction is ``und`` with score 0.
    """
    model = fit(docs, scratch)
    # The text goes to Python and doesn't come back.
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
