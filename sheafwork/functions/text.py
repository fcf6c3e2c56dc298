"""Column helpers for text with Unicode-aware patterns.

``(?d)`` makes ``.``, ``^`` and ``$`` know line feeds only, ``(?U)`` widens the classes to Unicode.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every boundary that ends a line.
LINE_END = "[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: What ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that ``(?iU)`` takes for an ``s`` or ``i``, while ``lower`` doesn't make one of them.
ODD_CASE = "ſıİ"


def pattern(p: str, flags: str = "") -> str:
    return f"(?dU{flags}){p}"


def replace(c: Column, p: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(c, pattern(p, flags), by)


def replace_all(c: Column, rules: Iterable[Sequence[str]]) -> Column:
    """Rules (pattern, replacement[, flags]) in order; the order is part of what they mean."""
    for rule in rules:
        c = replace(c, *rule)
    return c


def odd_case(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in ODD_CASE])


def replace_found(c: Column, rules: Iterable[Sequence[str]]) -> Column:
    """Rules (literal, pattern, replacement[, flags]) in order, each run only on texts that hold its literal, in whatever case.

    A match has to hold the literal, and no rule may make a literal of a later one.
    """
    given = F.array(*[F.struct(F.lit(lit.lower()).alias("lit"), F.lit(pattern(p, *flags)).alias("p"), F.lit(by).alias("by")) for lit, p, by, *flags in rules])

    def run(x: Column) -> Column:
        found = F.filter(given, lambda r: x["odd"] | F.contains(x["low"], r["lit"]))
        return F.aggregate(found, x["c"], lambda acc, r: F.regexp_replace(acc, r["p"], r["by"]))

    return let(c, lambda c: let(F.struct(c.alias("c"), F.lower(c).alias("low"), odd_case(c).alias("odd")), run))


def matches(c: Column, p: str, flags: str = "") -> Column:
    return c.rlike(pattern(p, flags))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    return F.filter(F.split(c, pattern(r"\s+")), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    Chains of steps that name their input several times would else cost a power of it.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def unified(c: Column) -> Column:
    """Line feeds in place of all that ends a line."""
    other = reduce(lambda a, b: a | b, [c.contains(x) for x in OTHER_ENDS])
    return F.when(other, F.regexp_replace(c, LINE_END, "\n")).otherwise(c)


def lines(c: Column) -> Column:
    """The lines of a text; one at the end that is empty is none."""
    split = let(c, lambda x: F.split(unified(x), "\n", -1))
    return let(split, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def full_lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def joined(a: Column, by: str = "\n") -> Column:
    return F.array_join(a, by)


def keep_lines(c: Column, keep) -> Column:
    return joined(F.filter(lines(c), keep))


def sentences(c: Column) -> Column:
    return F.split(c, pattern(r"(?<=[.!?])\s+"), -1)


def hits(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    terms = list(terms)
    return let(F.lower(c), lambda low: reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms]))


def has_any(c: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    return let(F.lower(c), lambda low: reduce(lambda a, b: a | b, [low.contains(t) for t in terms]))


def collapse(c: Column) -> Column:
    return joined(words(c), " ")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
