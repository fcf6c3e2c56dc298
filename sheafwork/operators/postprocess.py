"""Response post-processing: model phrasing, resource sections, markdown, bullets, repeats, empty sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions import vocab as V

ASSISTANT = "the assistant"
#: Distinct lines after which repeats are forgotten.
RECENT = 120

# Fixed values: (pattern, replacement[, flags]) in order.
MARKDOWN_RULES = [(r"#\s+#", "##"), (r"#+([^\s#])", "# $1"), (r"^\s*#\s+#\s+", "## ", "m"), (r"\*\*\s*(.*?)\s*\*\*", r"**$1**"), (r"\*{3,}", "**"), (r"^(#{1,6})\s+\*\*(.*?)\*\*$", "$1 $2", "m")]
BULLET_RULES = [(r"^\s*[•●○▪■]\s*", "- ", "m"), (r"^\s*[–—]\s+", "- ", "m"), (r"^\s*-\s*", "- ", "m")]
NUMBER_RULES = [(r"^\s*(\d+)\)\s+", "$1. ", "m"), (r"^\s*(\d+)\.\s*", "$1. ", "m")]
SPACING_RULES = [("[ \\t]+", " "), (r"\n\s+\n", "\n\n"), ("\\n{3,}", "\n\n")]


def wrapper_patterns(assistant: str = ASSISTANT) -> list[str]:
    named = "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in assistant)
    return [*V.WRAPPERS, *[p.replace("NAME", named) for p in V.NAMED_WRAPPERS], *V.LATE_WRAPPERS]


def strip_wrappers(c: Column, assistant: str = ASSISTANT) -> Column:
    return T.replace_all(c, [(p, "", "i") for p in wrapper_patterns(assistant)])


def resource_patterns() -> list[str]:
    return [rf"#{{1,4}}\s*{h}[\s\S]*" for h in V.RESOURCE_HEADS] + [rf"{h}[\s\S]*" for h in V.RESOURCE_HEADS + V.RESOURCE_WORDS]


def strip_resources(c: Column) -> Column:
    return T.replace_all(c, [(p, "", "i") for p in resource_patterns()])


def strip_closings(c: Column) -> Column:
    return T.keep_lines(c, lambda x: T.let(T.strip(x), lambda s: ~reduce(lambda a, b: a | b, [T.matches(s, p, "i") for p in V.CLOSINGS])))


def fix_markdown(c: Column) -> Column:
    return T.replace_all(c, MARKDOWN_RULES)


def post_bullets(c: Column) -> Column:
    return T.replace_all(c, BULLET_RULES)


def broken_bullets(c: Column) -> Column:
    return T.keep_lines(c, lambda x: T.let(T.strip(x), lambda s: ~(s.isin(V.BROKEN_BULLETS) | T.matches(s, r"\A-\s*[-–—_*.\s]+\z"))))


def numbered_lists(c: Column) -> Column:
    return T.replace_all(c, NUMBER_RULES)


def _is_heading(stripped: Column) -> Column:
    return stripped.startswith("#") | (stripped.startswith("**") & stripped.endswith("**"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose 0-based numbers aren't in ``gone``, joined."""
    every = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return T.joined(F.transform(F.array_except(every, gone), lambda i: F.get(lines, i)))


def heading_key(stripped: Column) -> Column:
    return F.lower(T.replace(stripped, r"^[#*\s\d.]+|[#*\s]+$", ""))


def _without_repeats(lines: Column, keys: Column) -> Column:
    """The lines but those whose key (structs k, i; null: none) an earlier one has. Sorted by key and place, all but the first of equal ones go."""
    by_key = F.array_sort(F.filter(keys, lambda x: x["k"].isNotNull()))
    return T.let(by_key, lambda s: _without(lines, F.transform(F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))), lambda x: x["i"])))


def dedup_headings(c: Column) -> Column:
    """The first of each heading text stays."""
    key = lambda x, i: T.let(T.strip(x), lambda s: F.struct(F.when(_is_heading(s), heading_key(s)).alias("k"), i.alias("i")))
    return T.let(T.lines(c), lambda l: _without_repeats(l, F.transform(l, key)))


def dedup_lines(c: Column, recent: int | None = RECENT) -> Column:
    """Repeats (case-folded) of lines that aren't blank go; what was seen is forgotten after ``recent`` lines (None: never).

    The fold holds at most ``recent`` lines and the numbers of the repeats; without a limit there is none.
    """
    if recent is None:
        key = lambda x, i: F.struct(F.nullif(F.lower(T.strip(x)), F.lit("")).alias("k"), i.alias("i"))
        return T.let(T.lines(c), lambda l: _without_repeats(l, F.transform(l, key)))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("gone"))
    none = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        low = x["low"]
        new = (low == "") | ~F.array_contains(a["seen"], low)
        seen = F.when((low == "") | ~new, a["seen"]).otherwise(F.when(F.size(a["seen"]) + 1 > recent, none).otherwise(F.concat(a["seen"], F.array(low))))
        return F.struct(seen.alias("seen"), F.when(new, a["gone"]).otherwise(F.concat(a["gone"], F.array(x["i"]))).alias("gone"))

    def kept(l: Column) -> Column:
        numbered = F.transform(l, lambda x, i: F.struct(F.lower(T.strip(x)).alias("low"), i.alias("i")))
        return _without(l, F.aggregate(numbered, start, step, lambda a: a["gone"]))

    return T.let(T.lines(c), kept)


def drop_empty_sections(c: Column) -> Column:
    """A heading goes where the next line that isn't blank is a heading, or there is none."""
    def kept(l: Column) -> Column:
        places = F.filter(F.transform(l, lambda x, i: F.struct(T.strip(x).alias("s"), i.alias("i"))), lambda s: s["s"] != "")

        def rest(full: Column) -> Column:
            # Of the full lines, those that start a section without content.
            bad = F.filter(full, lambda s, k: s["s"].startswith("#") & F.coalesce(F.get(full, k + 1)["s"].startswith("#"), F.lit(True)))
            return _without(l, F.transform(bad, lambda s: s["i"]))

        return T.let(places, rest)

    return T.let(T.lines(c), kept)


def post_spacing(c: Column) -> Column:
    return T.strip(T.replace_all(c, SPACING_RULES))


POSTPROCESS = [
    ("wrappers", strip_wrappers), ("resources", strip_resources), ("closings", strip_closings), ("markdown", fix_markdown), ("bullets", post_bullets), ("broken_bullets", broken_bullets),
    ("numbered_lists", numbered_lists), ("duplicate_headings", dedup_headings), ("duplicate_lines", dedup_lines), ("empty_sections", drop_empty_sections), ("spacing", post_spacing),
]


def postprocess(df: DataFrame, text: str = "text", out: str = "final_text", assistant: str = ASSISTANT, recent: int | None = RECENT) -> DataFrame:
    """All steps in order; adds the text, both lengths and the step names."""
    own = {"wrappers": (assistant,), "duplicate_lines": (recent,)}
    d = df.withColumn("_c", T.text_or_empty(F.col(text)))
    for name, step in POSTPROCESS:
        d = d.withColumn("_c", step(F.col("_c"), *own.get(name, ())))
    d = d.withColumn(out, F.col("_c")).drop("_c")
    return d.withColumn("original_length", F.length(T.text_or_empty(F.col(text)))).withColumn("final_length", F.length(out)).withColumn("steps", F.array(*[F.lit(n) for n, _ in POSTPROCESS]))
