"""Output formatting: markdown cleaning, the shape of each task, tables, sections, title, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions import vocab as V
from sheafwork.operators.structure import ends_with, strip_pipes

# Fixed values: (pattern, replacement[, flags]) in order.
MARKDOWN_RULES = [
    (r"#\s+#", "#"), (r"#{3,}\s+", "## "), (r"^(#{1,6})\s+\*\*(.*?)\*\*$", "$1 $2", "m"), (r"\*\*(.*?)\*\*", "$1"),
    (r"(?<!\*)\*(?!\s)(.*?)(?<!\s)\*(?!\*)", "$1"), (r"^\s*\*\s+", "- ", "m"), ("\\n{3,}", "\n\n"), ("[ \\t]+", " "),
]
PLAIN_RULES = [(r"#{1,6}\s+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1")]
PLAIN_END_RULES = [("`(.*?)`", "$1"), ("\\n{3,}", "\n\n")]
LIST_MARK = r"\A[-*\d.]+\s*"


def clean_markdown(c: Column) -> Column:
    return T.strip(T.replace_all(T.text_or_empty(c), MARKDOWN_RULES))


def _cells(line: Column) -> Column:
    return F.transform(F.split(strip_pipes(T.strip(line)), r"\|", -1), T.strip)


def _is_row(s: Column) -> Column:
    return s.startswith("|") & s.endswith("|")


def valid_table(c: Column) -> Column:
    """Three pipe-bounded lines or more, of which two say something."""
    def says(rows: Column) -> Column:
        full = F.filter(rows, lambda s: ~T.matches(s, r"\A\|[\s\-:|]+\|\z") & F.exists(_cells(s), lambda x: x != ""))
        return (F.size(rows) >= 3) & (F.size(full) >= 2)

    return T.let(F.filter(T.full_lines(c), _is_row), says)


def drop_blank_rows(c: Column) -> Column:
    return T.strip(T.keep_lines(c, lambda x: ~(T.strip(x).startswith("|") & ~F.exists(_cells(x), lambda s: s != ""))))


def rows_to_markdown(rows: Column) -> Column:
    """A table of rows, short ones and empty cells filled with "Not specified"; body rows of nothing else go; '' under two rows."""
    none = F.lit(V.UNSPECIFIED)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def made(full: Column) -> Column:
        head = F.element_at(full, 1)
        body = F.transform(F.filter(F.slice(full, 2, F.size(full)), lambda r: F.exists(r, lambda x: (x != "") & (x != V.UNSPECIFIED))), line)
        return T.strip(T.joined(F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), F.size(head)))), body)))

    def filled(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        full = F.transform(rows, lambda r: F.concat(F.transform(r, lambda x: T.strip(F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(x))), F.array_repeat(none, width - F.size(r))))
        return F.when(F.size(rows) >= 2, T.let(full, made)).otherwise("")

    return T.let(rows, filled)


def _unmarked(line: Column) -> Column:
    return T.strip(T.replace(line, LIST_MARK, ""))


def action_table(c: Column) -> Column:
    """The first 20 lines as actions without owner, deadline, priority or notes."""
    items = F.filter(F.slice(F.transform(T.full_lines(c), _unmarked), 1, 20), lambda x: x != "")
    none = F.lit(V.UNSPECIFIED)
    rows = F.concat(F.array(F.array(*map(F.lit, ["Action", "Owner", "Deadline", "Priority", "Notes"]))), F.transform(items, lambda x: F.array(x, none, none, none, none)))
    return F.coalesce(F.nullif(rows_to_markdown(rows), F.lit("")), c)


def named_sections(c: Column, names: list[str]) -> Column:
    """As it is where two of the names occur; else the first line under the first name, and stubs."""
    stubs = "".join(f"\n\n{n}\n{V.NOT_AVAILABLE}" for n in names[1:])

    def shaped(c: Column) -> Column:
        first = F.get(T.full_lines(c), F.lit(0))
        built = T.let(first, lambda x: F.when(x.isNull(), c).otherwise(F.concat(F.lit(names[0] + "\n"), x, F.lit(stubs))))
        return F.when(T.hits(c, [n.lower() for n in names]) >= 2, c).otherwise(built)

    return T.let(c, shaped)


def email_shell(c: Column) -> Column:
    """Fewer than 8 words are left without the template's lines."""
    low = F.transform(T.full_lines(c), lambda x: F.regexp_replace(F.lower(x), r"\A[\[\]]+|[\[\]]+\z", ""))
    useful = F.filter(low, lambda x: ~x.isin(V.EMAIL_SHELL) & ~T.matches(x, r"\Asubject:\s*\z"))
    return T.n_words(T.joined(useful, " ")) < 8


def email_body(source: Column) -> Column:
    def body(one: Column) -> Column:
        parts = F.filter(F.transform(T.sentences(one), T.strip), lambda x: x != "")
        return F.when(one == "", V.NO_EMAIL_SOURCE).otherwise(F.array_join(F.slice(parts, 1, 5), " "))

    return T.let(T.collapse(T.text_or_empty(source)), body)


def email_subject(source: Column) -> Column:
    first = F.regexp_replace(F.element_at(T.sentences(T.collapse(T.text_or_empty(source))), 1), r"\A[ .]+|[ .]+\z", "")
    # The words of a first sentence without outer spaces are parted by one space each.
    short = T.let(first, lambda f: F.when(T.n_words(f) > 10, F.array_join(F.slice(T.words(f), 1, 10), " ")).otherwise(f))
    return F.coalesce(F.nullif(F.substring(short, 1, 90), F.lit("")), F.lit(V.UNSPECIFIED))


def email_repair(c: Column, source: Column) -> Column:
    """Kept with a subject line and words of its own; else built of its lines, or of the source."""
    def repaired(c: Column) -> Column:
        lines = F.transform(F.filter(T.lines(c), lambda x: T.strip(x) != ""), lambda x: F.regexp_replace(x, r"\A[ -]+|[ -]+\z", ""))
        own = T.joined(lines, "\n\n")  # '' where there are none
        body = T.let(own, lambda b: F.when((b == "") | email_shell(b), email_body(source)).otherwise(b))
        built = T.strip(F.concat(F.lit("Subject: "), email_subject(source), F.lit("\n\nDear Recipient,\n\n"), body, F.lit("\n\nRegards,\n\n[Your Name]")))
        return F.when(T.matches(c, r"^subject\s*:", "im") & ~email_shell(c), c).otherwise(built)

    return T.let(c, repaired)


def task_shape(c: Column, task: Column, source: Column) -> Column:
    def shaped(t: Column) -> Column:
        out = F.when(task == "email_draft", email_repair(t, source)).when((task == "action_items") & ~valid_table(t), action_table(t))
        for name, names in V.NAMED_SECTIONS.items():
            out = out.when(task == name, named_sections(t, names))
        return out.otherwise(t)

    return T.let(T.strip(c), shaped)


def rows_from_patterns(c: Column) -> Column:
    """array of rows: ``key: value`` lines under Field and Value (two or more), else pipe rows (two or more), else empty."""
    return T.let(T.full_lines(c), _rows_from_lines)


def _rows_from_lines(lines: Column) -> Column:
    none = F.array().cast("array<array<string>>")
    pairs = F.filter(F.transform(F.filter(F.transform(lines, _unmarked), lambda x: x.contains(":")), lambda x: F.array(T.strip(F.regexp_extract(x, r"(?s)\A([^:]*):(.*)\z", 1)), T.strip(F.regexp_extract(x, r"(?s)\A([^:]*):(.*)\z", 2)))), lambda p: (p[0] != "") & (p[1] != ""))
    cells = F.filter(F.transform(F.filter(lines, lambda x: x.contains("|")), lambda x: F.filter(_cells(x), lambda s: s != "")), lambda r: F.size(r) >= 2)
    columns = T.let(cells, lambda a: F.when(F.size(a) >= 2, a).otherwise(none))
    return T.let(pairs, lambda a: F.when(F.size(a) >= 2, F.concat(F.array(F.array(F.lit("Field"), F.lit("Value"))), a)).otherwise(columns))


def ensure_table(c: Column, tables: Column | None = None, fields: Column | None = None) -> Column:
    """A valid table without its blank rows; else rows found in the text; else the structure's tables; else its
    fields; else items of the first 20 lines; else the text.
    """
    return T.let(c, lambda t: _ensure_table(t, tables, fields))


def _ensure_table(c: Column, tables: Column | None, fields: Column | None) -> Column:
    found = rows_from_patterns(c)
    lines = F.transform(F.slice(T.full_lines(c), 1, 20), lambda x, i: F.array((i + 1).cast("string"), _unmarked(x)))
    items = F.concat(F.array(F.array(F.lit("Item"), F.lit("Details"))), F.filter(lines, lambda r: r[1] != ""))
    options = [rows_to_markdown(found)]
    if tables is not None:
        made = F.filter(F.transform(tables, lambda t: rows_to_markdown(t["rows"])), lambda x: x != "")
        options.append(F.when(F.size(made) > 0, F.element_at(made, 1)))
    if fields is not None:
        rows = F.concat(F.array(F.array(F.lit("Field"), F.lit("Value"))), F.transform(fields, lambda f: F.array(f["key"], f["value"])))
        options.append(F.when(F.size(fields) > 0, rows_to_markdown(rows)))
    options.append(rows_to_markdown(items))
    return F.when(valid_table(c), drop_blank_rows(c)).otherwise(F.coalesce(*[F.nullif(o, F.lit("")) for o in options], c))


def clean_heading(c: Column) -> Column:
    return T.strip(F.regexp_replace(T.replace(c, r"\A[#\s]+", ""), "[*_`]", ""))


def valid_section_heading(c: Column) -> Column:
    return (c != "") & (T.n_words(c) <= 12) & ~ends_with(c, ".,;:") & ~T.matches(c, r"\A\d+\.\s+[A-Z].*:")


def extract_sections(c: Column) -> Column:
    """array<struct(heading, level, content)>, contentless ones but the first dropped. A fold over the lines."""
    struct = "array<struct<heading:string,level:int,content:array<string>>>"
    none = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, T.pattern(r"\A(#{1,4})\s+(.+)\z"), 1)
        bold = F.regexp_extract(x, T.pattern(r"\A\*\*(.+?)\*\*\z"), 1)
        head = clean_heading(T.strip(F.when(mark != "", F.regexp_extract(x, T.pattern(r"\A(#{1,4})\s+(.+)\z"), 2)).otherwise(bold)))
        level = F.when(mark != "", F.length(mark)).otherwise(2)
        starts = valid_section_heading(head)
        last = F.try_element_at(a, F.lit(-1))
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["heading"].alias("heading"), last["level"].alias("level"), F.concat(last["content"], F.array(x)).alias("content"))))
        return F.when(starts, F.concat(a, F.array(F.struct(head.alias("heading"), level.alias("level"), none.alias("content"))))).when(F.size(a) > 0, grown).otherwise(a)

    found = F.aggregate(T.full_lines(c), F.array().cast(struct), step)
    return F.filter(found, lambda s, i: (i == 0) | (F.size(s["content"]) > 0))


def extract_title(c: Column, sections: Column) -> Column:
    l = T.lines(T.strip(c))
    first = F.when(F.size(l) > 0, F.substring(T.strip(F.regexp_replace(F.element_at(l, 1), "[*#_`]", "")), 1, 120)).otherwise("")
    return F.when(F.size(sections) > 0, F.element_at(sections, 1)["heading"]).otherwise(first)


def tables_to_plain(c: Column) -> Column:
    def plain(x: Column) -> Column:
        s = T.strip(x)
        return F.when(_is_row(s), F.when(~F.exists(_cells(s), lambda q: ~T.matches(q, r"\A[-:\s]+\z")), F.lit(None)).otherwise(F.array_join(_cells(s), " | "))).otherwise(x)

    return T.joined(F.filter(F.transform(T.lines(c), plain), lambda x: x.isNotNull()))


def plain_text(c: Column) -> Column:
    return T.strip(T.replace_all(tables_to_plain(T.replace_all(c, PLAIN_RULES)), PLAIN_END_RULES))


def detect_format(task: Column) -> Column:
    pairs = [F.lit(x) for kv in V.OUTPUT_FORMAT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), task), F.lit("general_output"))


def format_output(df: DataFrame, text: str = "text", task: str = "task", source: str = "source_text", tables: str | None = None, fields: str | None = None) -> DataFrame:
    """Adds markdown, plain_text, sections, section_count, title and format."""
    d = df.withColumn("_m", clean_markdown(F.col(text))).withColumn("_m", task_shape(F.col("_m"), F.col(task), F.col(source)))
    table = ensure_table(F.col("_m"), F.col(tables) if tables else None, F.col(fields) if fields else None)
    d = d.withColumn("markdown", F.when(F.col(task) == "table_format", table).otherwise(F.col("_m"))).drop("_m")
    d = d.withColumn("sections", extract_sections(F.col("markdown"))).withColumn("title", extract_title(F.col("markdown"), F.col("sections")))
    return d.withColumn("plain_text", plain_text(F.col("markdown"))).withColumn("format", detect_format(F.col(task))).withColumn("section_count", F.size("sections"))
