"""Byte-pair merges of many words at once in numpy, for tokenizers whose words end in a suffix.

The merges are those of the tokenizer's own file. Words of plain Latin letters, digits and ASCII marks go
this way; all others, and whatever could hold one of the file's added tokens, are left to the tokenizers
library. Both give the same ids, as merges never cross the words that the tokenizer's own pattern finds.
``understood`` says whether a file has the rules that this holds for.
"""

from __future__ import annotations

import json
import re

import numpy as np

from sheafwork.llm.kneser_ney import Table

#: Latin letters that are one code point in normal form C and whose lower case is one as well.
LETTERS = "a-zA-ZÀ-ÖØ-öø-įĲ-ňŊ-ž"
SIMPLE = re.compile(rf"[{LETTERS}0-9!-/:-@\[-`{{-~]+")
# The rules of a file that this module knows.
RULES = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
#: The word pattern, for these characters.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")

#: Words, a line each, with a character that is not of SIMPLE or with an apostrophe, which the word pattern may bind to letters.
ODD = re.compile(rf"^.*[^{LETTERS}0-9!-&(-/:-@\[-`{{-~\n].*$", re.MULTILINE)
#: The kinds of bytes in other words: beyond ASCII all are of letters.
LETTER, DIGIT, MARK, GAP = range(4)
KIND = np.array([GAP if b == 10 else LETTER if b >= 128 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)


def added(path: str) -> list[bytes]:
    """The texts of the file's added tokens, which are found as they are written, before all else."""
    return [t["content"].encode() for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]


def understood(path: str) -> bool:
    """Whether words split at ASCII white space, lower-cased but for added tokens, have the ids of their text."""
    file = json.load(open(path, encoding="utf-8"))
    model = file["model"]
    same = all(file.get(k) == v for k, v in RULES.items()) and all(model.get(k) == v for k, v in MODEL.items())
    plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not re.search(r"\s", t["content"]) for t in file["added_tokens"])
    whole = all(c in model["vocab"] and c + (model["end_of_word_suffix"] or "") in model["vocab"] for c in byte_letters())
    return same and plain and whole and bool(model["end_of_word_suffix"])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = len(vocab) + 1
        self.pair = Table(np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The little-endian 32-bit ids of each word, merged as one part; no word is empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self._encode(np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words), dtype=np.int32), size), np.arange(len(words)))

    def encode_plain(self, words: list[bytes]) -> list[bytes]:
        """The little-endian 32-bit ids of words that ``odd`` does not name, each cut as ``split`` cuts it."""
        raw = np.frombuffer(b"\n".join(words).decode("utf-8").lower().encode("utf-8"), np.uint8)
        kind = KIND[raw]
        # A part ends where the kind changes; a digit is a part, and so is each word.
        first = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        gap = kind == GAP
        word = np.cumsum(gap, dtype=np.int32)[~gap]
        first = first[~gap]
        return self._encode(raw[~gap], np.cumsum(first, dtype=np.int32) - np.int32(1), word[first])

    def _encode(self, raw: np.ndarray, part: np.ndarray, word: np.ndarray) -> list[bytes]:
        """raw: bytes of all words; part: the part of each byte; word: the word of each part. Each word's ids."""
        sym, of = self.inner[raw], part
        ends = np.flatnonzero(np.append(of[1:] != of[:-1], True))
        sym[ends] = self.last[raw[ends]]
        # rank[i]: of the pair of i and the next symbol
        rank = self._ranks(sym, of, np.arange(len(sym)))
        out_sym, out_of = [], []
        while len(sym):
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(rank, start)
            each = np.repeat(best, np.diff(np.append(start, len(sym))))
            done = each == self.none
            if done.any():
                out_sym.append(sym[done])
                out_of.append(of[done])
                sym, of, rank, each = sym[~done], of[~done], rank[~done], each[~done]
                if not len(sym):
                    break
            hit = rank == each
            # Of a run of overlapping pairs every other one merges, from the left.
            if (hit[1:] & hit[:-1]).any():
                first = hit & ~np.append(False, hit[:-1])
                at = np.arange(len(hit))
                hit &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
            merged = np.flatnonzero(hit)
            sym[merged] = self.made[rank[merged]]
            # Only pairs with a merged symbol have new ranks.
            new = hit.copy()
            new[:-1] |= hit[1:]
            stay = ~np.append(False, hit[:-1])
            sym, of, rank, new = sym[stay], of[stay], rank[stay], np.flatnonzero(new[stay])
            rank[new] = self._ranks(sym, of, new)
        sym, of = np.concatenate(out_sym), np.concatenate(out_of)
        by = np.argsort(of, kind="stable")
        data = sym[by].astype("<u4").tobytes()
        cuts = 4 * np.append(0, np.cumsum(np.bincount(word[of], minlength=int(word[-1]) + 1)))
        cuts = cuts.tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ranks(self, sym: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair at each place ``at`` and the next one, or ``none`` where these do not merge."""
        rank = np.full(len(at), self.none, np.int32)
        last = at[-1] == len(sym) - 1 if len(at) else False
        here = at[:-1] if last else at
        near = np.flatnonzero(of[here] == of[here + 1])
        here = here[near]
        got = self.pair.find(sym[here] * self.base + sym[here + 1])
        rank[near[got >= 0]] = got[got >= 0]
        return rank


def odd(words: list[bytes]) -> set[bytes]:
    """Those of the lower-cased words that ``Merges.encode_plain`` can't take."""
    return {w.encode("utf-8") for w in ODD.findall(b"\n".join(words).decode("utf-8"))}


def split(word: bytes) -> list[bytes] | None:
    """The tokenizer's words of a lower-cased word, or None where it must see the word itself."""
    if word.isalpha():  # bytes: ASCII letters
        return [word]
    if word[:-1].isalpha() and word[-1:] in b".,;:!?":
        return [word[:-1], word[-1:]]
    text = word.decode("utf-8")
    if not SIMPLE.fullmatch(text):
        return None
    return [w.encode() for w in WORD.findall(text.lower())]
