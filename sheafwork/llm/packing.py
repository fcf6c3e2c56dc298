"""Best-fit packing of token sequences (op 7).

Pattern packing by non-negative least squares (after Krell et al., "Efficient Sequence Packing without
Cross-contamination", 2021): a histogram of piece lengths, patterns of two and three lengths that fill a
sequence exactly, repeat counts fitted to the histogram, rounded, and the residual histogram packed by best
fit in decreasing length. Only the histogram (``seq_len`` counts) reaches the driver; pieces are
ranked within their length on the executors and find their place in the pattern table, whose size
depends on ``seq_len`` and not on the data.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm import bpe
from sheafwork.llm.common import Scratch, small_batches

SEQ_LEN = 2048
TOKENIZER = "word_bpe_49k.json"
SEPARATOR = 0
#: Rows of one length that one task ranks.
RANKED_ROWS = 100_000
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 500_000
#: Bytes of text whose new words are merged together.
AT_ONCE = 4_000_000

#: A capital and the first byte of a code point from 0x300 on, where combining marks begin.
COMPOSED = re.compile(rb"[A-Z][\xcc-\xff]")


class WordTokenizer:
    """Whole-text ids through a cache of words.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words
    split at ASCII white space, joined. New words of a batch are merged together; up to two times ``cached``
    words and those of a batch are held, the least lately met of which go. It ignores case but in
    its added tokens and where a mark after a letter is composed first: such a word goes to the library as
    it is written. A file of other rules than ``bpe`` knows goes to the library text by text.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.encode, self.cached = Tokenizer.from_file(path).encode_batch, cached
        self.merges = bpe.Merges(path) if bpe.understood(path) else None
        self.marks = [m.lower() for m in bpe.added(path)]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def cased(self, text: bytes, lower: bytes) -> bool:
        """Whether case may matter: a possible added token, or a capital before a character that may be a mark."""
        return any(m in lower for m in self.marks) or not text.isascii() and bool(COMPOSED.search(text))

    def words(self, text: bytes) -> list[bytes]:
        lower = text.lower()  # ASCII only
        if not self.cased(text, lower):
            return lower.split()
        return [w if self.cased(w, w.lower()) else w.lower() for w in text.split()]

    def learn(self, new: set[bytes], cased: bool) -> None:
        """Make new words known. cased: some are perhaps as they are written."""
        other = {w for w in new if self.cased(w, w.lower())} if cased else set()
        plain = list(new - other)
        if odd := bpe.odd(plain):
            plain = [w for w in plain if w not in odd]
            split = {w: bpe.split(w) for w in odd}
            other.update(w for w, ps in split.items() if ps is None)
            parts = list({p for ps in split.values() if ps for p in ps})
            ids = dict(zip(parts, self.merges.encode(parts), strict=True)) if parts else {}
            self.known.update((w, b"".join([ids[p] for p in ps])) for w, ps in split.items() if ps is not None)
        if plain:
            self.known.update(zip(plain, self.merges.encode_plain(plain), strict=True))
        other = list(other)
        for w, e in zip(other, self.encode([w.decode("utf-8") for w in other], add_special_tokens=False) if other else (), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return next(self.all_ids([text]))

    def all_ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Of each text in order, some megabytes of text at a time."""
        if self.merges is None:
            for t in texts:
                yield np.array(self.encode([t.decode("utf-8")], add_special_tokens=False)[0].ids, "<u4").tobytes()
            return
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            if len(self.known) > self.cached:  # words that are met again come back from the older ones
                self.known, self.older = {}, self.known
            lower = [t.lower() for t in texts[at:end]]
            cased = [self.cased(t, x) for t, x in zip(texts[at:end], lower, strict=True)]
            words = [self.words(t) if c else x.split() for t, x, c in zip(texts[at:end], lower, cased, strict=True)]
            known, older = self.known, self.older
            new = set().union(*words).difference(known)
            back = new.intersection(older)
            known.update((w, older[w]) for w in back)
            new -= back
            if new:
                self.learn(new, any(cased))
            for w in words:
                yield b"".join(map(known.__getitem__, w))
            at = end


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for a Python worker, kept from task to task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and id 0, cut only if longer than a sequence."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, ids in zip(b.column(0).to_pylist(), tok.all_ids(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    part = ids[at : at + 4 * seq_len]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(seq_len: int, have: np.ndarray) -> list[tuple[int, ...]]:
    """All patterns of two and three present lengths that fill a sequence. have[n]: count of length n.

    At most about seq_len ** 2 / 12 (350,000), whatever the data.
    """
    there = np.array([n for n in np.flatnonzero(have[:seq_len]) if n], np.int64)
    found = [(n, seq_len - n) for n in there.tolist() if 2 * n >= seq_len and have[seq_len - n]]
    for x, a in enumerate(there.tolist()):
        b = there[: x + 1]
        c = seq_len - a - b
        fits = (c > 0) & (c <= b)
        b, c = b[fits], c[fits]
        there_too = have[c] > 0
        found += [(a, *p) for p in zip(b[there_too].tolist(), c[there_too].tolist(), strict=True)]
    return found


def fit(have: np.ndarray, found: list[tuple[int, ...]], rounds: int = 5, sweeps: int = 4) -> np.ndarray:
    """Non-negative repeat counts x with A x near ``have`` in least squares, by coordinate descent from 0.

    A round is a sweep over all patterns, then up to ``sweeps`` over those in use. It ends early where no
    pattern of a whole sweep moves by a quarter of a repeat, which rounding would hide.
    """
    rest = have.astype(float).tolist()
    x = [0.0] * len(found)
    squares = [sum(p.count(n) ** 2 for n in set(p)) for p in found]

    def sweep(some: Iterable[int]) -> float:
        moved = 0.0
        for j in some:
            p = found[j]
            d = max(-x[j], sum([rest[n] for n in p]) / squares[j])
            if d:
                x[j] += d
                for n in p:
                    rest[n] -= d
                moved = max(moved, abs(d))
        return moved

    for _ in range(rounds):
        if sweep(range(len(found))) < 0.25:
            break
        for _ in range(sweeps):
            if sweep([j for j, v in enumerate(x) if v > 0]) < 0.05:
                break
    return np.array(x)


def plan(have: np.ndarray, seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that use each length n exactly have[n] times.

    Repeat counts are rounded to the nearest; as that may use up small lengths that the rest needs, a plan
    with them rounded down is made as well, and one without patterns, which stands where few pieces leave
    little to fit. That of the fewest sequences stands, of equal ones the first.
    """
    left = have.astype(np.int64).copy()
    full = int(left[seq_len])
    left[seq_len] = 0
    found = patterns(seq_len, left)
    x = fit(left, found)
    plans = [rounded(left, found, x, up, seq_len) for up in (0.5, 0.0, -np.inf)]
    return [((seq_len,), full)] * bool(full) + min(plans, key=lambda p: sum(n for _, n in p))


def rounded(have: np.ndarray, found: list[tuple[int, ...]], x: np.ndarray, up: float, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """The patterns as often as their counts, plus ``up`` and cut, and lengths allow; the rest by best fit."""
    left, out = have.copy(), []
    order = np.argsort(-x, kind="stable")
    for j in order[x[order] + up >= 1].tolist():
        n = min([int(x[j] + up), *(int(left[m]) // found[j].count(m) for m in found[j])])
        if n > 0:
            out.append((found[j], n))
            for m in found[j]:
                left[m] -= n
    # The residual: best fit in decreasing length, whole groups of equal sequences at a time.
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    open_ = np.zeros(seq_len + 1, bool)
    for n in range(seq_len - 1, 0, -1):
        c = int(left[n])
        while c:
            at = n + int(np.argmax(open_[n:])) if open_[n:].any() else -1
            if at < 0:
                each = seq_len // n
                for p, k in (((n,) * each, c // each), ((n,) * (c % each), 1)):
                    if p and k:
                        room[seq_len - n * len(p)].append((p, k))
                        open_[seq_len - n * len(p)] = True
                break
            p, k = room[at].pop()
            used = min(k, c)
            if used < k:
                room[at].append((p, k - used))
            open_[at] = bool(room[at])
            room[at - n].append(((*p, n), used))
            open_[at - n] = True
            c -= used
    return out + [g for groups in room.values() for g in groups]


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): which sequence and offset a rank of a length gets."""
    rows, taken, base = [], defaultdict(int), 0
    for p, repeats in planned:
        at = 0
        for n in sorted(set(p), reverse=True):
            rows.append(((n << 44) + taken[n], base, repeats, at, n))
            taken[n] += repeats * p.count(n)
            at += n * p.count(n)
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "base", "repeats", "at", "length"), table.T.copy(), strict=True))


def pack(docs: DataFrame, scratch: Scratch, tokenizer_path: str, seq_len: int = SEQ_LEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token (id 0). Repeated rows are packed each. An empty table
    gives no rows; other columns are not read. Ties of length are ranked by id, piece and checksum.
    """
    cut = scratch.put(pieces(docs, tokenizer_path, seq_len, key, text))
    have = np.zeros(seq_len + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most seq_len rows
        have[r["length"]] = r["count"]
    table = docs.sparkSession.sparkContext.broadcast(places(plan(have, seq_len)))
    salts = np.maximum(1, -(-have // RANKED_ROWS))
    hot = {int(n): int(salts[n]) for n in np.flatnonzero(salts > 1)}
    n_salts = F.lit(1)
    if hot:
        n_salts = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("length").cast("int")], F.lit(1))
    dealt = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), n_salts))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    if hot:
        before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = dealt.groupBy("length", "salt").count().select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("o"))
        ranked = ranked.join(offsets, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("rank") + F.col("o"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            keys = (length << 44) + rank
            i = np.searchsorted(t["key"], keys, "right") - 1
            k = keys - t["key"][i]
            seq, off = t["base"][i] + k % t["repeats"][i], t["at"][i] + k // t["repeats"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
