"""Interpolated modified Kneser-Ney over character n-grams, in numpy (Chen and Goodman, 1999)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 5
#: Low bits of a character in a key, and the bits above them, which go to a second column.
CHAR, HIGH = 12, 9
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _packed(c: np.ndarray, bits: int) -> np.ndarray:
    n = len(c) - ORDER + 1
    out = np.zeros(n, np.int64)
    for i in range(ORDER):
        out = out << bits | c[i : i + n]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def keys(text: str) -> np.ndarray:
    """The low bits of the ORDER-gram that ends at each character, packed; the text is preceded by line ends."""
    return both(text)[0]


def highs(text: str) -> np.ndarray | None:
    """The high bits of the same ORDER-grams, or None where all are 0."""
    return both(text)[1]


def both(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """``keys`` and ``highs``."""
    c = _codes(text)
    up = c >> CHAR
    return _packed(c & ((1 << CHAR) - 1), CHAR), _packed(up, HIGH) if up.any() else None


def fold(low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    """A non-negative number for each n-gram: its low bits where its high bits are 0, else a hash of 63 bits."""
    if high is None:
        return low
    x = high.astype(np.uint64) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return ((low.astype(np.uint64) ^ x ^ (x >> np.uint64(32))) & np.uint64((1 << 63) - 1)).astype(np.int64)


class Table:
    """A hash table of distinct non-negative keys; ``find`` gives a key's row or -1, for many at once."""

    def __init__(self, known: np.ndarray):
        self.bits = max(4, int(2 * len(known) + 1).bit_length() + 1)
        self.key, self.row = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(known)), self._slot(known)
        while len(left):
            free = self.key[at] < 0
            # Of several that want a free slot, the one that wrote last has it.
            self.key[at[free]] = known[left[free]]
            won = free & (self.key[at] == known[left])
            self.row[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int32)
        at = self._slot(wanted)
        got = self.key[at]
        hit = got == wanted
        out[hit] = self.row[at[hit]]
        left = np.flatnonzero(~hit & (got >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.key[at]
            hit = got == wanted[left]
            out[left[hit]] = self.row[at[hit]]
            more = ~hit & (got >= 0)
            left, at = left[more], at[more]
        return out


@dataclass
class Order:
    grams: Table
    logp: np.ndarray  # of seen grams, interpolated; a row for each model
    histories: Table
    logb: np.ndarray  # the share that a history leaves to the lower order; a row for each model


@dataclass
class Whole:
    """What a shard of models must know of the others: if codes are high, the bigrams, how many n-grams count 1 to 4, by order.

    All but the bigrams' keys are by model.
    """

    wide: list[bool]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]
    many: dict[int, list[list[float]]]


def shard(k: np.ndarray, high: np.ndarray | None, shards: int) -> np.ndarray:
    """The shard of each ORDER-gram, by the two characters before its last; SHARD in SQL."""
    x = (k >> CHAR & ((1 << 2 * CHAR) - 1)) * 40503
    if high is not None:
        x = x + (high >> HIGH & ((1 << 2 * HIGH) - 1)) * 2654435761
    return x % 1000003 % shards


#: The same of the columns gram and high, before the last remainder.
SHARD = f"((shiftright(gram, {CHAR}) & {(1 << 2 * CHAR) - 1}) * 40503L + (shiftright(high, {HIGH}) & {(1 << 2 * HIGH) - 1}) * 2654435761L) % 1000003"


class Model:
    """Models of several selections of one trusted text, which share their keys; one model if counts have one row.

    An n-gram that a model lacks has there the probability that backing off would give it, a history it
    lacks leaves all to the lower order: so each gives what it would give with keys of its own.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, high: np.ndarray | None = None, whole: Whole | None = None):
        """grams: distinct ORDER-gram keys with their counts in the trusted text, by model; high: their high bits.

        With ``whole`` these are the n-grams of one shard, all that share the two characters before their last.
        """
        high = np.zeros(len(grams), np.int64) if high is None else high
        counts = np.atleast_2d(counts).astype(float)
        # The base is even over the low codes where the trusted text has no others, else over all.
        wide = [bool(high[c > 0].any()) for c in counts] if whole is None else whole.wide
        symbols = [1 << (CHAR + HIGH * w) for w in wide]
        self.base = -np.log(symbols)
        by = np.argsort(fold(grams, high))
        level = {ORDER: (grams[by], high[by], counts[:, by])}
        for n in range(ORDER - 1, 0, -1):
            # Below the top an n-gram counts the distinct characters before it.
            low, up = level[n + 1][0] & ((1 << CHAR * n) - 1), level[n + 1][1] & ((1 << HIGH * n) - 1)
            _, one, of = np.unique(fold(low, up), return_index=True, return_inverse=True)
            c = np.array([np.bincount(of, x > 0, len(one)) for x in level[n + 1][2]])
            level[n] = whole.pairs if whole and n == 2 else (low[one], up[one], c)
        self.orders: dict[int, Order] = {}
        below = None
        for n in range(1, ORDER + 1):
            k, up, c = level[n]
            h, of = np.unique(fold(k >> CHAR, up >> HIGH), return_inverse=True)
            grams_ = Table(fold(k, up))
            at = None if below is None else below[0].find(fold(k & ((1 << CHAR * (n - 1)) - 1), up & ((1 << HIGH * (n - 1)) - 1)))
            p, left = np.empty((len(c), len(k))), np.empty((len(c), len(h)))
            for m, own in enumerate(c):
                total = np.bincount(of, own, len(h))
                many = whole.many[n][m] if whole and n > 2 else [float((own == x).sum()) for x in (1, 2, 3, 4)]
                y = many[0] / max(1.0, many[0] + 2 * many[1])
                d = [min(x + 0.95, max(0.05, x + 1 - (x + 2) * y * many[x + 1] / max(1.0, many[x]))) for x in range(3)]
                cut = np.array([0.0, *d])[np.minimum(own, 3).astype(np.int64)]
                total, left[m] = np.maximum(total, 1.0), np.where(total > 0, np.bincount(of, cut, len(h)) / np.maximum(total, 1.0), 1.0)
                p[m] = (own - cut) / total[of] + left[m][of] * (1.0 / symbols[m] if at is None else below[1][m][at])
            self.orders[n] = Order(grams_, np.log(p), Table(h), np.log(left))
            below = (grams_, p)

    def log_probabilities(self, k: np.ndarray, high: np.ndarray | None, which: list[np.ndarray | int]) -> list[np.ndarray]:
        """ln P(last character | those before it) of each key, for each of ``which``: a model for all keys or one for each."""
        outs, left = [np.zeros(len(k)) for _ in which], np.arange(len(k))

        def add(values: np.ndarray, some: np.ndarray, row: np.ndarray) -> None:
            for w, out in zip(which, outs, strict=True):
                out[some] += values[w][row] if isinstance(w, int) else values[w[some], row]

        for n in range(ORDER, 0, -1):
            o = self.orders[n]
            part, up = k[left] & ((1 << CHAR * n) - 1), None if high is None else high[left] & ((1 << HIGH * n) - 1)
            row = o.grams.find(fold(part, up))
            seen = row >= 0
            add(o.logp, left[seen], row[seen])
            left, part, up = left[~seen], part[~seen], None if up is None else up[~seen]
            if not len(left):
                return outs
            h = o.histories.find(fold(part >> CHAR, None if up is None else up >> HIGH))
            add(o.logb, left[h >= 0], h[h >= 0])
        for w, out in zip(which, outs, strict=True):
            out[left] += self.base[w] if isinstance(w, int) else self.base[w[left]]
        return outs

    def log_probability(self, k: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """ln P(last character | those before it) of each key, of the first model."""
        return self.log_probabilities(k, high, [0])[0]

    def text_log_probability(self, text: str) -> np.ndarray:
        return self.log_probability(keys(text), highs(text))
