"""Secret scans (op 8), in DataFrame functions only.

Base patterns give spans; the method adds spans where a sliding window over a candidate string has a
Shannon entropy above the threshold of the candidate's character class, unless an allow list
suppresses it. Window counts are kept incrementally: one character enters, one leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed values of the contract. (kind, pattern, least length, group whose length counts)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more in all; a shorter run holds no other match
HEX = r"[0-9a-f]{16,}"  # maximal runs, so the same as dropping runs under 16
ASSIGN_LEAST = 12

#: Candidates of the entropy scan: runs of key-like characters of at least a window.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The classes of a candidate, the first that fits, and the bits that a window of WINDOW characters needs.
CLASSES = [("[0-9a-fA-F]+", 3.0), ("[A-Z0-9]+", 3.4), ("[A-Za-z0-9]+", 3.6), ("[A-Za-z0-9+/=]+", 3.7), ("[A-Za-z0-9+/_=-]+", 3.7)]
#: Not secrets: UUIDs, placeholders, sequences of the alphabet or of digits, runs of six or more of one character.
ALLOW = r"(?i)(example|sample|placeholder|changeme|xxxx|abcdefgh|01234567|12345678|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|"
ALLOW += "|".join(f"{c}{{6,}}" for c in [*"abcdefghijklmnopqrstuvwxyz0123456789/_=-", r"\+"]) + ")"
#: Codes of ASCII characters; the counts of a window are an array with a slot for each.
SLOTS = 128


SPANS = "array<struct<start:int,ord:int,kind:string,end:int,match:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Leftmost non-overlapping matches: struct(start, order, kind, end, match), in code points.

    ``split`` gives the gaps between the matches of ``regexp_extract_all``, so running lengths give the
    places. A fold copies what it has gathered at each step, so n matches are summed in blocks of about
    the square root of n, and the blocks are laid end to end.
    """
    none = F.array().cast(SPANS)

    def place(found: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(found).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int")), lambda k: F.slice(found, k * size + 1, size))

        def laid(parts: Column) -> Column:
            length = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
            starts = F.aggregate(length, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

            def step(acc: Column, x: Column) -> Column:
                start = acc["at"] + F.length(x["gap"])
                end = start + F.coalesce(F.length(x["match"]), F.lit(0))
                span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
                return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

            def block(z: Column) -> Column:
                return F.aggregate(z["part"], F.struct(z["start"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])

            return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(starts, F.lit(1), F.size(parts)).alias("start")), block))

        return _let(blocks, laid)

    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(text.rlike(pattern), _let(found, place)).otherwise(none)


def _covered(text: Column, spans: Column) -> Column:
    """A byte for each code point of the text: 1 inside one of the sorted spans, else 0."""

    def bits(held: Column) -> Column:
        # The end of the span before stands beside each span, so nothing is looked up in the array.
        before = F.concat(F.array(F.lit(0)), F.transform(held, lambda x: x["end"]))
        one = F.transform(F.arrays_zip(F.slice(before, F.lit(1), F.size(held)).alias("free"), held.alias("x")), lambda z: F.concat(F.repeat(F.lit("0"), z["x"]["start"] - z["free"]), F.repeat(F.lit("1"), z["x"]["end"] - z["x"]["start"])))
        return F.concat(F.array_join(one, ""), F.repeat(F.lit("0"), F.length(text) - F.element_at(before, -1))).cast("binary")

    return _let(spans, bits)


def _c_log_c(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of a window of ``width`` characters of the ASCII string ``s``.

    State: counts by character and the sum of c log2 c. A step adds the entering character and takes
    the leaving one away, so it costs the same whatever the window. Shorter strings give 0.
    """
    start = F.struct(F.array_repeat(F.lit(0), SLOTS).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def bump(n: Column, i: Column, by: int) -> Column:
        return F.concat(F.slice(n, F.lit(1), i), F.array(F.element_at(n, i + 1) + by), F.slice(n, i + 2, F.lit(SLOTS)))

    def over(chars: Column) -> Column:
        def slot(i: Column) -> Column:
            return F.ascii(F.element_at(chars, i))

        def step(acc: Column, i: Column) -> Column:
            into = slot(i)
            c = F.element_at(acc["n"], into + 1)
            grown = F.struct(bump(acc["n"], into, 1).alias("n"), (acc["sum"] + _c_log_c(c + 1) - _c_log_c(c)).alias("sum"), acc["best"].alias("best"))

            def leave(g: Column) -> Column:
                out = slot(i - width)
                d = F.element_at(g["n"], out + 1)
                return F.struct(bump(g["n"], out, -1).alias("n"), (g["sum"] + _c_log_c(d - 1) - _c_log_c(d)).alias("sum"), g["best"].alias("best"))

            left = F.when(i > width, F.element_at(F.transform(F.array(grown), leave), 1)).otherwise(grown)
            bits = lambda g: F.log2(F.lit(float(width))) - g["sum"] / width
            seen = F.transform(F.array(left), lambda g: F.struct(g["n"].alias("n"), g["sum"].alias("sum"), F.when(i >= width, F.greatest(g["best"], bits(g))).otherwise(g["best"]).alias("best")))
            return F.element_at(seen, 1)

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda acc: acc["best"])

    # The characters are split once, as a lambda's variable.
    return F.when(F.length(s) >= width, _let(F.split(s, ""), over)).otherwise(F.lit(0.0))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans (the digest is of the empty string). Repeated rows and ids each
    give a row; an empty table gives none; other columns are not read. Texts are scanned whole. Added
    spans (kind ``entropy``) are only those that no base span overlaps; the threshold is that of the
    candidate's character class. The work is linear in the text, but for its matches' places: n to the 1.5.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), t.alias("t"))
    base = rows.select(
        "doc_id",
        "t",
        F.filter(_spans(F.col("t"), ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("a"),
        _spans(F.col("t"), ACCESS, "access", 1).alias("k"),
        _spans(F.col("t"), HEX, "hex", 2).alias("h"),
        _spans(F.col("t"), CANDIDATE, "entropy", 3).alias("c"),
    )

    known = F.concat("a", "k", "h")

    def secret(x: Column, cover: Column) -> Column:
        m = x["match"]
        # Keys and hex runs consist of a candidate's characters, so one that it meets lies inside it.
        met = F.coalesce(F.contains(F.substring(cover, x["start"] + 1, x["end"] - x["start"]), F.lit("1").cast("binary")), F.lit(False)) | m.rlike(ACCESS) | m.rlike(HEX)
        # Letters alone are words of prose and digits alone are numbers; a key mixes both.
        mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
        bits = F.coalesce(*[F.when(m.rlike(f"^{c}$"), F.lit(b)) for c, b in CLASSES])
        return mixed & ~met & ~m.rlike(ALLOW) & (window_entropy(m) >= bits)

    # Bound, or it would be made again for each candidate.
    cover = F.when((F.size("a") > 0) & (F.size("c") > 0), _covered(F.col("t"), F.col("a")))
    added = _let(F.struct(cover.alias("cover"), F.col("c").alias("c")), lambda z: F.filter(z["c"], lambda x: secret(x, z["cover"])))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return base.select(
        "doc_id",
        F.size("a").cast("long").alias("n_assign"),
        F.size("k").cast("long").alias("n_access"),
        F.size("h").cast("long").alias("n_hex"),
        F.sha2(joined(known).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(known, added)).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)]
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{name}' AS kind, string_split_regex(t, {quoted(p)}) AS g, regexp_extract_all(t, {quoted(p)}) AS m FROM d" for k, (name, p) in enumerate(kinds))
    bits = " ".join(f"WHEN regexp_full_match(m, {quoted(c)}) THEN {b}" for c, b in CLASSES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
u AS (SELECT doc_id, ord, kind, unnest(g[:len(m)]) AS g, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM f WHERE len(m) > 0),
p AS (SELECT doc_id, ord, kind, m, (sum(len(g) + len(m)) OVER (PARTITION BY doc_id, ord ORDER BY i))::BIGINT AS stop FROM u),
s AS (SELECT *, stop - len(m) AS start FROM p WHERE ord <> 0 OR len(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}),
c AS (SELECT * FROM s WHERE ord = 3 AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, {quoted(ALLOW)})
  AND list_max(list_transform(range(1, len(m) - {WINDOW - 2}), lambda k: list_entropy(string_split(m[k:k + {WINDOW - 1}], '')))) >= CASE {bits} END),
x AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ord < 3 AND s.doc_id = c.doc_id AND s.start < c.stop AND c.start < s.stop)),
a AS (SELECT * FROM s WHERE ord < 3 UNION ALL SELECT * FROM x),
j AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, ord) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""


ORACLE = _oracle()
