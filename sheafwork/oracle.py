"""DuckDB SQL of the document operators, built from small expression helpers.

Patterns are RE2: no look-around and no back-references, ``\\b`` spelled out with Unicode classes.
"""

from __future__ import annotations

from collections.abc import Iterable

from sheafwork.functions import vocab as V

NL = "chr(10)"
EDGE = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(t: str, p: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({t}, {q((f'(?{flags})' if flags else '') + p)}, {q(by)}, 'g')"


def rules(t: str, table: Iterable[tuple]) -> str:
    for p, by, *flags in table:
        for k in range(1, 5):
            by = by.replace(f"${k}", f"\\{k}")
        t = rep(t, p, by, flags[0] if flags else "")
    return t


def has(t: str, p: str, flags: str = "") -> str:
    return f"regexp_matches({t}, {q((f'(?{flags})' if flags else '') + p)})"


def strip(t: str) -> str:
    return rep(t, r"^\s+|\s+$", "")


def lines(t: str) -> str:
    return f"(CASE WHEN ends_with({t}, {NL}) OR {t} = '' THEN string_split({t}, {NL})[:-2] ELSE string_split({t}, {NL}) END)"


def full(t: str) -> str:
    return f"list_filter(list_transform({lines(t)}, lambda x: {strip('x')}), lambda x: x <> '')"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"


def n_words(t: str) -> str:
    return f"len({words(t)})"


def join(a: str, by: str = NL) -> str:
    return f"coalesce(array_to_string({a}, {by}), '')"


def collapse(t: str) -> str:
    return join(words(t), "' '")


def keep(t: str, cond: str) -> str:
    return join(f"list_filter({lines(t)}, lambda x: {cond})")


def sentences(t: str) -> str:
    return f"string_split({rep(t, r'([.!?])\s+', chr(92) + '1' + chr(1))}, chr(1))"


def hits(t: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains(lower({t}), {q(x)})::INT" for x in terms) + ")"


def any_(t: str, terms: Iterable[str]) -> str:
    return f"({hits(t, terms)} > 0)"


def one_of(t: str, values: Iterable[str]) -> str:
    return f"{t} IN ({', '.join(map(q, values))})"


def count_in(t: str, mark: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(mark)}, ''))) // {len(mark)})"


def case(pairs: Iterable[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


def lookup(t: str, table: dict, other: str) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return f"CASE {t} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {other} END"


def whole_word(t: str, word: str, by: str) -> str:
    """Twice, as neighbours share the character between them."""
    for _ in range(2):
        t = rep(t, f"(^|{EDGE})(?:{word})($|{EDGE})", rf"\1{by}\2", "i")
    return t


# ---- understanding ----
def questions(t: str) -> str:
    return f"({count_in(t, '?')} >= 2 OR {hits(t, V.QUESTION_WORDS)} >= 3)"


def meeting(t: str) -> str:
    return f"({hits(t, V.MEETING_WORDS)} >= 2)"


def document_type(t: str) -> str:
    return case([(f"{strip(t)} = ''", "'unknown'"), (questions(t), "'question_answer_or_exam_material'"), (meeting(t), "'professional_or_meeting_notes'"), (any_(t, V.STUDY_WORDS), "'student_study_material'"), (any_(t, V.BUSINESS_WORDS), "'business_document'")], "'general_document'")


def noise_word(w: str) -> str:
    return case([(f"length({w}) <= 2", "false"), (f"length({rep(w, r'[\p{L}\p{N}]', '')}) / length({w}) > 0.45", "true"), (f"{has(w, r'\p{Nd}')} AND {has(w, r'\p{L}')}", has(w, "[A-Za-z][0-9]|[0-9][A-Za-z]"))], "false")


def ocr_clean(t: str) -> str:
    t = f"translate(replace({t}, chr(13), {NL}), '•·', '--')"
    return join(f"list_filter(list_transform({lines(t)}, lambda x: {collapse('x')}), lambda x: x <> '')")


# ---- cleanup ----
def input_text(t: str) -> str:
    t = rules(f"replace({t}, chr(13), {NL})", [("[ \\t]+", " "), ("\\n{3,}", "\n\n"), ("[\\t\\f\\r ]+", " ")])
    for ch in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~":
        t = rep(t, f"\\{ch}{{5,}}", "\\\\" if ch == "\\" else ch)
    return strip(t)


def basic_spacing(t: str) -> str:
    return rep(f"translate({t}, chr(13) || chr(9), {NL} || ' ')", " {2,}", " ")


def bullets(t: str) -> str:
    return rules(t, [("[•●○▪■]+", "-"), (r"^\s*[–—]\s+", "- ", "m")])


def page_noise(t: str) -> str:
    bad = " OR ".join(has(f"lower({strip('x')})", p, "i") for p in V.PAGE_NOISE)
    return keep(f"replace({t}, chr(13), {NL})", f"{strip('x')} = '' OR NOT ({bad})")


def punctuation(t: str) -> str:
    t = rep(t, "([!?;:])([A-Za-z0-9])", r"\1 \2")
    for _ in range(2):
        t = rep(t, r"(^|[^0-9])\.([A-Za-z])", r"\1. \2")
    return rep(t, ",([A-Za-z])", r", \1")


def case_split(t: str) -> str:
    return rep(t, "([a-z])([A-Z])", r"\1 \2")


def merges(t: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        t = whole_word(t, k, v)
    return t


def ocr_merges(t: str) -> str:
    return merges(case_split(t), V.CLEANUP_MERGES)


def repeated(t: str) -> str:
    return rep(t, "([.,!?]){2,}", r"\1")


def newlines(t: str) -> str:
    return rules(t, [(" {2,}", " "), ("\\n{3,}", "\n\n")])


def numbers(t: str) -> str:
    t = rep(t, rf"(^|{EDGE})([0-9]+)\.\s+([0-9]+)($|{EDGE})", r"\1\2.\3\4")
    return rep(t, rf"(^|{EDGE})([0-9]{{1,2}})([A-Z][A-Za-z])", r"\1\2 \3")


def markers(t: str) -> str:
    for m in V.DENSE_MARKERS:
        t = rep(t, rf"\s+({m}\s*:)", "\n\n\\1", "i")
    t = rep(t, rf"\s+({V.GUIDELINE})", "\n\n\\1")
    return rep(t, rf"\.\s*({V.GUIDELINE})", ".\n\n\\1")


def roman(t: str) -> str:
    return rep(t, rf"\s+((?:{V.ROMAN})\.\s+[A-Z])", "\n\\1")


def quotes(t: str) -> str:
    return rep(rep(t, "word'([A-Za-z])", r"word '\1"), rf"'([A-Za-z]+)to($|{EDGE})", r"'\1' to\2")


# ---- structure ----
def noise_norm(x: str) -> str:
    x = strip(rep(x, r"\s+", " "))
    return rep(rep(x, rf"(^|{EDGE})page\s+[0-9]+($|{EDGE})", r"\1page\2", "i"), rf"(^|{EDGE})[0-9]+\s*/\s*[0-9]+($|{EDGE})", r"\1page\2")


def noise_candidate(x: str) -> str:
    return f"({x} <> '' AND {n_words(x)} <= 12 AND ({any_(x, V.NOISE_WORDS)} OR {has(x, '^[0-9]+$')}))"


def inline_headings(t: str) -> str:
    t = rep(t, r"\s+((?:Chapter|Unit|Section)\s+[0-9]+[:.\-]?\s+[A-Z][A-Za-z0-9 ,:&\-]{4,90})", "\n\n\\1", "i")
    return strip(rep(t, r"\s+([0-9]+\.\s+[A-Z][A-Za-z ,:&\-]{8,80})(\s+[A-Z])", "\n\n\\1\\2"))


def ends(t: str, marks: str) -> str:
    return "(" + " OR ".join(f"ends_with({t}, {q(m)})" for m in marks) + ")"


def title(first: str) -> str:
    fits = " OR ".join(has(first, p) for p in V.TITLE_PATTERNS)
    low = f"length({rep(first, r'[^\p{Ll}]', '')}) / greatest(length({first}), 1)"
    return f"CASE WHEN {first} IS NOT NULL AND {n_words(first)} <= 12 AND NOT {ends(first, '.?!')} AND {low} <= 0.65 AND ({fits}) THEN {first} ELSE '' END"


def valid_heading(x: str) -> str:
    layout = f"({has(x, r'^[1-5]\.')} AND {any_(x, V.LAYOUT_WORDS)})"
    return f"({x} <> '' AND {n_words(x)} <= 10 AND length({x}) <= 80 AND NOT {ends(x, '.,;:')} AND NOT {layout} AND NOT {any_(x, V.HEADING_REJECTS)} AND NOT {has(x, r'[0-9]+\.\s*[0-9]+')})"


def heading(x: str) -> str:
    return f"(({has(x, V.HEADING, 'i')} OR {has(x, V.NUMBERED_HEADING)}) AND {valid_heading(x)})"


def question(x: str) -> str:
    return f"(contains({x}, '?') OR {has(x, r'^(q[0-9]+\.?|question\s+[0-9]+)', 'i')} OR " + " OR ".join(f"starts_with(lower({x}), {q(s)})" for s in V.QUESTION_STARTS) + ")"


def bullet(x: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(b)})" for b in V.BULLETS) + ")"


def paragraphs(t: str) -> str:
    blocks = f"list_filter(list_transform(string_split_regex({t}, '\\n\\s*\\n'), lambda x: {strip('x')}), lambda x: x <> '')"
    long_ = f"list_transform(list_filter({sentences(t)}, lambda x: {n_words('x')} > 8), lambda x: {strip('x')})"
    return f"(CASE WHEN len({blocks}) > 1 THEN {blocks} ELSE {long_} END)"


def tabular(x: str) -> str:
    return f"({x} <> '' AND ({count_in(x, '|')} >= 2 OR contains({x}, chr(9)) OR len(string_split_regex({x}, '\\s{{2,}}')) >= 3))"


def cells(x: str) -> str:
    c = f"trim({strip(x)}, '|')"
    by = f"(CASE WHEN contains({c}, '|') THEN string_split({c}, '|') WHEN contains({c}, chr(9)) THEN string_split({c}, chr(9)) ELSE string_split_regex({c}, '\\s{{2,}}') END)"
    got = f"list_filter(list_transform({by}, lambda z: {strip('z')}), lambda z: z <> '')"
    return f"(CASE WHEN {c} <> '' AND NOT {has(c, r'^[-:| ]+$')} AND len({got}) >= 2 THEN {got} END)"


def label(t: str) -> str:
    out = []
    for name, terms in V.LABEL_RULES:
        rule = any_(t, terms)
        if name == "question answer":
            rule = f"({rule} OR {has(f'lower({t})', '^(what|why|how)')})"
        out.append((rule, q(name)))
    return case(out, "'summary'")


# ---- chunks ----
def split_words(t: str, n: int = 220) -> str:
    w = words(t)
    return f"(CASE WHEN len({w}) > {n} THEN list_transform(range(0, len({w}), {n}), lambda i: array_to_string({w}[i + 1:i + {n}], ' ')) WHEN len({w}) > 0 THEN [{strip(t)}] ELSE [] END)"


def low_value(t: str) -> str:
    return f"({strip(t)} = '' OR {any_(t, V.LOW_VALUE_PHRASES)} OR {n_words(t)} < 4)"


def priority(t: str) -> str:
    return f"(CASE WHEN {any_(t, V.HIGH_TERMS)} THEN 90 WHEN {any_(t, V.MEDIUM_TERMS)} THEN 60 ELSE 50 END)"


def row(cells_: str) -> str:
    return f"'| ' || array_to_string({cells_}, ' | ') || ' |'"


# ---- post-processing ----
def wrappers(t: str, patterns: list[str]) -> str:
    for p in patterns:
        t = rep(t, p.replace(r"\A", "^"), "", "i")
    return t


def resources(t: str, patterns: list[str]) -> str:
    for p in patterns:
        t = rep(t, p, "", "i")
    return t


def closings(t: str) -> str:
    return keep(t, "NOT (" + " OR ".join(has(strip("x"), p, "i") for p in V.CLOSINGS) + ")")


def broken(t: str) -> str:
    return keep(t, f"NOT ({one_of(strip('x'), V.BROKEN_BULLETS)} OR {has(strip('x'), r'^-\s*[-–—_*.\s]+$')})")


def is_head(s: str) -> str:
    return f"(starts_with({s}, '#') OR (starts_with({s}, '**') AND ends_with({s}, '**')))"


# ---- formatting ----
def row_cells(x: str) -> str:
    return f"list_transform(string_split(trim({strip(x)}, '|'), '|'), lambda z: {strip('z')})"


def some_cell(x: str) -> str:
    return f"(len(list_filter({row_cells(x)}, lambda z: z <> '')) > 0)"


def valid_table(t: str) -> str:
    rows = f"list_filter({full(t)}, lambda x: starts_with(x, '|') AND ends_with(x, '|'))"
    return f"(len({rows}) >= 3 AND len(list_filter({rows}, lambda x: NOT {has('x', r'^\|[\s\-:|]+\|$')} AND {some_cell('x')})) >= 2)"


def drop_blank(t: str) -> str:
    return strip(keep(t, f"NOT (starts_with({strip('x')}, '|') AND NOT {some_cell('x')})"))


def unmarked(x: str) -> str:
    return strip(rep(x, r"^[-*0-9.]+\s*", ""))


def action_table(t: str) -> str:
    items = f"list_filter(list_transform({full(t)}, lambda x: {unmarked('x')})[1:20], lambda x: x <> '')"
    u = V.UNSPECIFIED
    body = f"list_transform({items}, lambda x: '| ' || x || ' | {u} | {u} | {u} | {u} |')"
    return f"(CASE WHEN len({items}) = 0 THEN {t} ELSE array_to_string(list_concat(['| Action | Owner | Deadline | Priority | Notes |', '| --- | --- | --- | --- | --- |'], {body}), {NL}) END)"


def named_sections(t: str, names: list[str]) -> str:
    stubs = f" || {NL} || {NL} || ".join(["", *[f"{q(n)} || {NL} || {q(V.NOT_AVAILABLE)}" for n in names[1:]]])
    return f"(CASE WHEN {hits(t, [n.lower() for n in names])} >= 2 OR len({full(t)}) = 0 THEN {t} ELSE {q(names[0])} || {NL} || {full(t)}[1]{stubs} END)"


def email_shell(t: str) -> str:
    low = f"list_transform({full(t)}, lambda x: trim(lower(x), '[]'))"
    useful = f"list_filter({low}, lambda x: NOT {one_of('x', V.EMAIL_SHELL)} AND NOT {has('x', r'^subject:\s*$')})"
    return f"({n_words(join(useful, chr(39) + ' ' + chr(39)))} < 8)"


def email_body(s: str) -> str:
    one = collapse(s)
    parts = f"list_filter(list_transform({sentences(one)}, lambda x: {strip('x')}), lambda x: x <> '')"
    return f"(CASE WHEN {one} = '' THEN {q(V.NO_EMAIL_SOURCE)} ELSE array_to_string({parts}[1:5], ' ') END)"


def email_subject(s: str) -> str:
    first = f"trim({sentences(collapse(s))}[1], ' .')"
    short = f"(CASE WHEN {n_words(first)} > 10 THEN array_to_string({words(first)}[1:10], ' ') ELSE {first} END)"
    return f"(CASE WHEN {collapse(s)} = '' THEN {q(V.UNSPECIFIED)} ELSE coalesce(nullif(substring({short}, 1, 90), ''), {q(V.UNSPECIFIED)}) END)"


def email_repair(t: str, s: str) -> str:
    ls = f"list_transform(list_filter({lines(t)}, lambda x: {strip('x')} <> ''), lambda x: trim(x, ' -'))"
    body = f"(CASE WHEN len({ls}) > 0 THEN array_to_string({ls}, {NL} || {NL}) ELSE {strip(t)} END)"
    body = f"(CASE WHEN {body} = '' OR {email_shell(body)} THEN {email_body(s)} ELSE {body} END)"
    gap = f" || {NL} || {NL} || "
    built = strip(f"('Subject: ' || {email_subject(s)}{gap}'Dear Recipient,'{gap}{body}{gap}'Regards,'{gap}'[Your Name]')")
    return f"(CASE WHEN {has(t, r'^subject\s*:', 'im')} AND NOT {email_shell(t)} THEN {t} ELSE {built} END)"


def plain_tables(t: str) -> str:
    s = strip("x")
    made = f"CASE WHEN starts_with({s}, '|') AND ends_with({s}, '|') THEN CASE WHEN len(list_filter({row_cells('x')}, lambda c: NOT {has('c', r'^[-:\s]+$')})) = 0 THEN NULL ELSE array_to_string({row_cells('x')}, ' | ') END ELSE x END"
    return join(f"list_filter(list_transform({lines(t)}, lambda x: {made}), lambda y: y IS NOT NULL)")


def plain_text(t: str) -> str:
    t = plain_tables(rules(t, [(r"#{1,6}\s+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1")]))
    return strip(rules(t, [("`(.*?)`", "$1"), ("\\n{3,}", "\n\n")]))


# ---- routing ----
def valid_mode(m: str, other: str = "student") -> str:
    return f"(CASE WHEN {one_of(f'lower({strip(m)})', V.TASKS)} THEN lower({strip(m)}) ELSE {q(other)} END)"


def valid_task(m: str, t: str) -> str:
    fits = " OR ".join(f"({m} = {q(k)} AND {one_of(f'lower({strip(t)})', ts)})" for k, ts in V.TASKS.items())
    return f"(CASE WHEN {fits} THEN lower({strip(t)}) ELSE {lookup(m, V.DEFAULT_TASK, q('short_summary'))} END)"


def token_budget(task: str, n: str, strategy: str) -> str:
    b = f"({lookup(task, V.TOKEN_BUDGET, '1000')})"
    sized = f"(CASE WHEN {n} < 180 THEN least({b}, 650) WHEN {n} > 1800 THEN least(greatest({b}, 1400), 1800) ELSE {b} END)"
    return f"(CASE WHEN {strategy} = 'hierarchical_summary' THEN least(greatest({sized}, 1100), 1600) ELSE {sized} END)"


def low_quality(t: str, p: str) -> str:
    s = strip(t)
    unfinished = " OR ".join(f"ends_with(lower({s}), {q(x)})" for x in V.UNFINISHED)
    return f"({s} = '' OR ({n_words(p)} > 1200 AND {n_words(s)} < 250) OR {unfinished} OR ({n_words(p)} > 1000 AND {count_in(s, '##')} + {count_in(s, '# ')} < 4) OR {has(s, r'\n-\s*$')} OR {has(s, r'\n-\s*[-–—]+\s*$')})"


def fallback(t: str, mode: str, task: str, notice: str) -> str:
    s = strip(t)
    rows = f"list_transform({full(s)}[1:12], lambda x, i: '| ' || i || ' | ' || replace(x, '|', '/') || ' |')"
    table = f"array_to_string(list_concat(['| Item | Details |', '| --- | --- |'], {rows}), {NL})"
    plain = f"{lookup(mode, V.LIMITED, q(V.LIMITED['general']))} || {NL} || {NL} || {q(notice)} || {NL} || {NL} || array_to_string({words(s)}[1:220], ' ')"
    return f"CASE WHEN {s} = '' THEN {q(V.NO_TEXT)} WHEN {task} = 'email_draft' THEN '' WHEN {task} = 'table_format' THEN {table} ELSE {plain.replace('CASE', '(CASE', 1).replace(' END', ' END)', 1)} END"
