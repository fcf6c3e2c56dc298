"""Main text of web pages (op 1).

Gradient-boosted trees over features of DOM nodes (tag, attribute tokens, depth, siblings, subtree text
density, links, punctuation, controls) give each block element the chance that it belongs to the article
if the element around it does. Decoding is hierarchical: the product of these chances down the tree is the
chance that a node belongs, which no descendant has more of than its ancestor, so no choice contradicts
another; keeping what has more than a half has the most expected right characters of all choices. The
trees are fitted here, on pages that ``make_page`` writes from a fixed seed (``TRAINING_PAGES`` of them).
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm import trees
from sheafwork.llm.common import small_batches
from sheafwork.llm.dom import INLINE, RAW, Page, parse

TRAINING_PAGES = 1200
#: Not rendered as text, or the face of a control: never judged (nor are hidden elements).
NEVER = RAW | frozenset("head button select option input datalist object audio video map dialog annotation annotation-xml rp".split())
CONTROLS = frozenset("input select textarea button".split())

# Attribute words by what they announce.
WORDS = {
    "content": "article content post entry main body story text page blog news articlebody paragraph prose markdown detail",
    "nav": "nav navigation menu breadcrumb breadcrumbs toc pagination pager tabs navbar topbar links sitemap skip",
    "head": "header masthead banner logo brand branding site top hero",
    "foot": "footer copyright legal colophon bottom imprint contentinfo",
    "side": "sidebar aside widget related recommended trending popular rail complementary more teaser side",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promoted promotion banner outbrain taboola dfp",
    "notice": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe subscription overlay toast paywall disclaimer warning",
    "form": "form search login signup signin register contact input field",
    "comment": "comment comments reply replies respond disqus discussion commentlist feedback review reviews thread",
    "share": "share sharing social like follow tweet facebook twitter",
    "meta": "meta byline author date tags tag category timestamp credits",
}
KINDS = list(WORDS)
KIND_OF = {w: KINDS.index(k) for k in reversed(KINDS) for w in WORDS[k].split()}
GROUPS = ["p", "h1 h2 h3 h4 h5 h6 hgroup", "li dt dd", "ul ol dl", "div center", "section", "article", "main", "nav menu search", "header", "footer", "aside", "form fieldset", "table tbody thead tfoot tr td th caption", "blockquote figure figcaption pre address details summary", "body html #root"]
GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}

def own_node(tag: str, words: tuple[str, ...]) -> bool:
    """Inline elements belong to the block around them, unless their attributes announce something."""
    return tag not in INLINE or any(w in KIND_OF for w in words)


def features(page: Page) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(a row for each judged node, the judged node of each node or -1 for what is never text, the judged nodes)."""
    nodes = page.nodes
    n = len(nodes)
    home, linked = [-1] * n, [False] * n
    for i, x in enumerate(nodes):
        if i and home[x.parent] < 0 or x.tag in NEVER or x.hidden:
            continue
        own = i == 0 or own_node(x.tag, x.words)
        home[i] = i if own else home[x.parent]
        linked[i] = x.tag == "a" or not own and linked[x.parent]
    judged = [i for i in range(n) if home[i] == i]
    direct, before, chars, links, stops, tags, paras, controls, heads = ([0] * n for _ in range(9))
    main, first = [False] * n, [False] * n
    # Text ahead of a node: runs and nodes both come in page order.
    seen = upto = 0
    for i, t in page.runs:
        if i >= 0 and home[i] >= 0:
            while upto <= i:
                before[upto] = seen
                upto += 1
            size = len(t.strip())
            seen += size
            direct[home[i]] += size
            chars[i] += size
            stops[i] += sum(map(t.count, ".,;:?!"))
            if linked[i]:
                links[i] += size
    before[upto:] = [seen] * (n - upto)
    for i in range(n - 1, 0, -1):
        up, tag = nodes[i].parent, nodes[i].tag
        controls[i] += tag in CONTROLS
        controls[up] += controls[i]
        if home[i] < 0:
            continue
        tags[i] += 1
        paras[i] += tag == "p"
        heads[i] += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        main[i] |= tag in ("article", "main")
        first[i] |= tag == "h1"
        chars[up] += chars[i]
        links[up] += links[i]
        stops[up] += stops[i]
        tags[up] += tags[i]
        paras[up] += paras[i]
        heads[up] += heads[i]
        main[up] |= main[i]
        first[up] |= first[i]
    total = max(1, chars[0])
    sibling, alike, repeated = [0] * n, [1] * n, [0] * n
    for i, x in enumerate(nodes):
        if x.children:
            named = [(nodes[c].tag, nodes[c].words[:1]) for c in x.children]
            count = Counter(named)
            for k, c in enumerate(x.children):
                sibling[c], alike[c] = k, count[named[k]]
            repeated[i] = max((v for (t, w), v in count.items() if w or t in ("li", "article", "section")), default=0)
    # What a node's attributes announce and its kind of tag, as bits; and those of the nodes above it.
    words, place, above, inside, crowd, held, rows = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n, [1.0] * n, []
    for i in judged:
        x = nodes[i]
        for w in x.words:
            if w in KIND_OF:
                words[i] |= 1 << KIND_OF[w]
        if x.tag in GROUP_OF:
            place[i] = 1 << GROUP_OF[x.tag]
        many = len(nodes[x.parent].children) if i else 1
        up = home[x.parent] if i else 0
        above[i], inside[i] = above[up] | words[up], inside[up] | place[up]
        # The most repeated kind of element a node is in, and the share of text of the innermost article.
        crowd[i] = max(crowd[up], alike[i] if x.tag not in ("p", "li", "tr", "td") else 1)
        held[i] = chars[i] / total if x.tag in ("article", "main") else held[up]
        c = chars[i]
        rows.append((
            min(x.depth, 40), direct[i], c, c / total, c / (tags[i] + 1), links[i] / max(1, c), stops[i] / max(1, c), paras[i],
            sibling[i] / max(1, many - 1), many, len(x.children), chars[x.parent] / total if i else 1.0, main[0], main[i], first[i], first[0],
            controls[i], heads[i], before[i] / total, alike[i], repeated[i], alike[up], repeated[up], crowd[i], held[i], c / max(1, chars[x.parent]) if i else 1.0,
        ))
    other = np.array(rows, np.float32)
    for k in (1, 2, 7, 16, 17):
        other[:, k] = np.log1p(other[:, k])
    at = np.array(judged)
    bits = [(np.array(a)[at][:, None] >> np.arange(size) & 1).astype(np.float32) for a, size in ((words, len(KINDS)), (above, len(KINDS)), (place, len(GROUPS)), (inside, len(GROUPS)))]
    return np.concatenate([other, *bits], 1), np.array(home), judged


def decode(page: Page, home: np.ndarray, judged: list[int], logits: np.ndarray) -> set[int]:
    """The nodes whose chance to be kept along with all around them is above a half."""
    chance = dict(zip(judged, (1 / (1 + np.exp(-logits))).tolist(), strict=True))
    chance[0] = 1.0  # the root is no element
    for i in judged[1:]:  # children come after their parents
        chance[i] *= chance[int(home[page.nodes[i].parent])]
    return {i for i in judged if chance[i] > 0.5}


def text_of(page: Page, home: np.ndarray, kept: set[int]) -> str:
    blocks, now = [], []
    for i, t in [*page.runs, (-1, "")]:
        if i < 0:
            if got := " ".join("".join(now).split()):
                blocks.append(got)
            now = []
        elif home[i] >= 0 and int(home[i]) in kept:
            now.append(t)
    return "\n\n".join(blocks)


def extract(pages: list[str | None], model: trees.Forest) -> list[str]:
    """The main text of each page; a null or empty page has none."""
    parsed = [parse(h) if h else None for h in pages]
    feats = [features(p) if p else None for p in parsed]
    rows = [f[0] for f in feats if f]
    logits = model.logits(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for p, f in zip(parsed, feats, strict=True):
        if not f:
            out.append("")
            continue
        mine = logits[at : at + len(f[0])]
        at += len(f[0])
        out.append(text_of(p, f[1], decode(p, f[1], f[2], mine)))
    return out


# ---- training pages ----


class _Writer:
    """One page: its HTML with each block element marked as kept (data-k) or not."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.syllables = ["".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiouéü") + rng.choice(["", "n", "r", "s", "t", "nd"])) for _ in range(40)]

    def words(self, n: int) -> str:
        r = self.r
        out = ["".join(r.choice(self.syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]
        for k in range(n):
            if r.random() < 0.12:
                out[k] += r.choice([",", ".", ".", ";"])
            if r.random() < 0.02:
                out[k] += r.choice(["&amp;", "!!", "***", "&quot;", "%%%"])
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!"])

    def tag(self, name: str, inner: str, keep: bool, cls: str = "") -> str:
        where = self.r.choice(["class", "id", "class"])
        return f"<{name}{f' {where}="{cls}"' if cls else ''} data-k={int(keep)}>{inner}</{name}>"

    def p(self, keep: bool, low: int = 4, high: int = 90) -> str:
        inner = self.words(self.r.randint(low, high))
        if self.r.random() < 0.2:
            inner = f'<a href="/x">{self.words(2)}</a> {inner}'
        if self.r.random() < 0.15:
            inner = f"<b>{self.words(6)}<br>" if self.r.random() < 0.5 else f"<em>{inner}</em>"
            return f"<p data-k={int(keep)}>{inner}" + ("</p>" if self.r.random() < 0.5 else "")
        return self.tag("p", inner, keep)

    def links(self, n: int, keep: bool = False, tag: str = "ul") -> str:
        return self.tag(tag, "".join(f'<li data-k={int(keep)}><a href="/{k}">{self.words(self.r.randint(1, 4))}</a></li>' for k in range(n)), keep)

    def unknown(self) -> str:
        """Attribute words that announce nothing."""
        return "-".join("".join(self.r.choice("abcdeghijklmnopqrstuvwxyz") for _ in range(self.r.randint(1, 7))) for _ in range(self.r.randint(1, 2)))

    def comments(self) -> str:
        r = self.r
        cls = r.choice(["comment", "reply", "response", "review", "", self.unknown(), "post"])
        name = r.choice(["div", "li", "article", "section", "div"])
        said = [lambda: self.p(False, 4, 80), lambda: self.p(False, 4, 80) + self.p(False, 2, 40), lambda: self.words(r.randint(2, 40))]
        one = [self.tag(name, r.choice(["", self.tag("div", self.words(2), False), f"<b>{self.words(1)}</b>"]) + r.choice(said)(), False, cls) for _ in range(r.randint(1, 7))]
        inner = "".join(one)
        if name == "li" and r.random() < 0.5:
            return inner
        if r.random() < 0.3:
            inner = self.tag("ol" if name == "li" else "div", inner, False, r.choice(["", "list", self.unknown()]))
        return self.tag(r.choice(["h2", "h3", "h4", "div"]), self.words(r.randint(1, 3)), False) + inner

    def junk(self, kind: str) -> str:
        r = self.r
        cls = r.choice([*WORDS[kind].split(), ""]) if kind != "content" else ""
        cls = r.choice([cls, f"{cls}-{r.choice(['box', 'wrap', 'list', 'inner', 'content', 'text', 'area', 'section', 'container'])}" if cls else ""])
        named = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}
        name = named[kind] if kind in named and (not cls or r.random() < 0.5) else r.choice(["div", "div", "section"])
        if name in ("div", "section") and not cls:
            cls = r.choice(WORDS[kind].split())
        # What its tag or what it holds tells need not be told by a word.
        if name not in ("div", "section") or kind in ("nav", "form", "comment", "share"):
            cls = r.choice([cls, cls, cls, "", self.unknown()])
        if kind == "nav":
            inner = r.choice([self.links(r.randint(2, 9)), self.links(r.randint(2, 9)), f'{self.words(1)} <a href="/a">{self.words(1)}</a> <a href="/b">{self.words(2)}</a>'])
            if name == "nav" and r.random() < 0.15:
                name = "menu"
        elif kind == "head":
            inner = r.choice([self.tag("div", self.words(2), False), self.tag("h1", self.words(3), False), ""]) + r.choice([self.links(4), self.tag("p", self.words(5), False), self.words(r.randint(1, 6))])
        elif kind == "foot":
            inner = r.choice(["&copy; example.com &middot; " + self.words(6), self.p(False, 4, 25), self.links(5) + self.p(False, 4, 20), self.p(False, 10, 60) + self.p(False, 10, 60)])
        elif kind == "side":
            cards = "".join(self.tag("article", self.tag("h3", f'<a href="/s">{self.words(4)}</a>', False) + self.p(False, 4, 20), False, r.choice(["", "card", "teaser"])) for _ in range(r.randint(2, 5)))
            inner = self.tag(r.choice(["h2", "h3", "h4"]), self.words(2), False) + r.choice([self.links(5), self.p(False, 5, 40), "".join(self.p(False, 5, 30) for _ in range(3)), cards])
        elif kind == "form":
            field_ = r.choice(["<input name=q>", "<input type=text><input type=email>", "<textarea>x</textarea>", "<select><option>a</option></select>"])
            inner = r.choice(["", self.tag("h3", self.words(2), False)]) + f"<label>{self.words(2)}</label>{field_}" + r.choice(["", self.p(False, 3, 15), self.p(False, 10, 60) + self.p(False, 10, 60)]) + f"<button>{self.words(1)}</button>"
        elif kind == "comment":
            inner = self.comments()
            if inner.startswith("<li"):
                name, cls = r.choice(["ol", "ul"]), cls or r.choice(WORDS[kind].split())
        elif kind == "share":
            inner = self.links(3)
        else:
            inner = r.choice([self.words(r.randint(4, 60)), self.p(False, 4, 60), self.tag("div", self.words(12), False)])
        return self.tag(name, inner, False, cls)

    def content_class(self) -> str:
        """Mostly a word for content; also none, unknown ones, and ones that mislead."""
        r = self.r
        true = r.choice([*WORDS["content"].split(), "post-content", "entry-content", "main-content"])
        wrong, more = (r.choice([w for k in KINDS if k not in ("content", "share") for w in WORDS[k].split()]) for _ in range(2))
        return r.choice([true, true, true, true, self.unknown(), "", f"{wrong}-{true}", f"{true} {wrong}", f"{self.unknown()}-{wrong}", f"{self.unknown()}-{more} {wrong}", f"{more} {wrong}"])

    def article(self) -> str:
        r = self.r
        parts = []
        title = self.tag("h1", self.words(r.randint(2, 12)), True)
        parts.append(r.choice([title, title, self.tag("header", title, True), ""]))
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.06:
                parts.append(self.tag("div", self.words(r.randint(5, 80)), True))
            elif kind < 0.72:
                parts.append(self.p(True, 1, r.choice([5, 120, 120])))
            elif kind < 0.8:
                parts.append(self.tag(r.choice(["h2", "h3"]), self.words(r.randint(1, 6)), True))
            elif kind < 0.87:
                parts.append(self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", self.words(r.randint(1, 20)), True) for _ in range(r.randint(1, 6))), True))
            elif kind < 0.91:
                parts.append(self.tag("blockquote", r.choice([self.words(20), self.p(True)]), True))
            elif kind < 0.94:
                parts.append(self.tag("pre", self.words(15), True))
            elif kind < 0.97:
                rows = "".join(self.tag("tr", "".join(self.tag("td", self.words(2), True) for _ in range(3)), True) for _ in range(3))
                parts.append(self.tag("table", rows, True))
            else:
                parts.append(self.tag("figure", self.tag("figcaption", self.words(6), True), True))
            if r.random() < 0.12:
                parts.append(self.junk(r.choice(["ad", "share", "side", "notice", "form"])))
        body = "".join(parts)
        if r.random() < 0.3:
            body = self.tag("div", body, True, r.choice(["", "content", "text", "inner", "entry-content", "col"]))
        if r.random() < 0.2:
            body += self.junk(r.choice(["comment", "share", "foot", "meta"]))
        cls = self.content_class()
        return r.choice([self.tag("article", body, True), self.tag("article", body, True, cls), self.tag("article", body, True, cls), self.tag("section", self.tag("div", body, True, cls), True, self.content_class()), self.tag("main", body, True), *[self.tag("div", body, True, cls)] * 3, self.tag("section", body, True, cls), self.tag("main", self.tag("article", body, True, r.choice(["", cls])) + r.choice(["", self.junk(r.choice(["comment", "side", "share", "nav"]))]), True), body])

    def page(self) -> str:
        r = self.r
        before = [self.junk(k) for k in ("head", "nav", "ad", "notice", "form", "nav", "side") if r.random() < 0.4]
        after = [self.junk(k) for k in ("comment", "side", "share", "ad", "foot", "notice", "nav") if r.random() < 0.4]
        inner = "".join([*before, self.article() if r.random() > 0.04 else "", *after])
        if r.random() < 0.4:
            inner = self.tag("div", inner, True, r.choice(["", "wrapper", "container", "page", "site", self.unknown()]))
        if r.random() < 0.06:
            inner = self.tag("form", "<input type=hidden>" + inner, True)
        return f"<!DOCTYPE html><html data-k=1><head><title>{self.words(4)}</title><style>p{{}}</style></head><body data-k=1>{inner}</body></html>"


def make_page(seed: int) -> str:
    """A training page; its block elements carry data-k=1 where they belong to the article."""
    return _Writer(random.Random(seed)).page()


@lru_cache(maxsize=1)
def model() -> trees.Forest:
    import re

    xs, ys, ws = [], [], []
    for seed in range(TRAINING_PAGES):
        source = make_page(seed)
        marks = iter(int(m) for m in re.findall(r"data-k=(\d)", source))
        page = parse(source)
        x, home, judged = features(page)
        # Marked elements come in page order, as do the nodes.
        marked = {i: next(marks) for i, n in enumerate(page.nodes) if n.tag in GROUP_OF and n.tag != "#root"}
        marked[0] = 1
        # Only what stands in kept elements: the chances are conditional.
        known = [k for k, i in enumerate(judged) if i and i in marked and marked.get(int(home[page.nodes[i].parent]))]
        xs.append(x[known])
        ys += [marked[judged[k]] for k in known]
        ws += (1 + 0.1 * x[known, 1]).tolist()
    return trees.fit(np.concatenate(xs), np.array(ys, float), np.array(ws))


def extract_pages(table: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null or empty html has empty text. Repeated rows give a row each, null ids and urls pass through, an
    empty table gives no rows, and other columns are not read. Nothing is cut, however long the page.
    """
    spark = table.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract(b.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = table.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
