"""A forgiving HTML tree: enough of the parsing rules to place every text run in its element.

One pass over the source; the time is linear in its length, however malformed it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

#: A tag from its name on. Quotes count only after an equals sign; one that is never closed ends at the
#: next ">". Nothing is tried twice (possessive), so a failing match costs its length once.
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>]*+))*+)(?:>|\Z)""")
ATTR = re.compile(r"""([^\s/>=]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg canvas".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp rtc s samp small span strike strong sub sup time tt u var label wbr br img output meter progress".split())
#: Elements without a text of their own that stand in a line, or aren't rendered: they don't end a block.
NO_BREAK = INLINE | RAW | frozenset("button input select object audio video map area embed link meta base param source track picture datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: tuple[str, ...] = ()
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    chars: int = 0  # of its own text


@dataclass
class Page:
    nodes: list[Node]
    #: Text runs in page order: (node, text), and (-1, "") where a block begins or ends.
    runs: list[tuple[int, str]]


def _attributes(source: str) -> tuple[tuple[str, ...], bool]:
    words: list[str] = []
    hidden = False
    for name, value in ATTR.findall(source):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            words += [w.lower() for w in PART.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value.strip("\"'") == "true" or name == "style" and UNSEEN.search(value):
            hidden = True
    return tuple(words), hidden


def parse(html: str) -> Page:
    nodes = [Node("#root", -1, 0)]
    runs: list[tuple[int, str]] = []
    stack = [0]
    #: Places in the stack by tag, and those of elements that aren't inline.
    places: dict[str, list[int]] = defaultdict(list)
    blocks = [0]

    def text(source: str) -> None:
        if source:
            t = unescape(source)
            nodes[stack[-1]].chars += len(t.strip())
            runs.append((stack[-1], t))

    def close(upto: int) -> None:
        """Close the open elements from place ``upto`` of the stack on."""
        if blocks[-1] >= upto:
            runs.append((-1, ""))
        while len(stack) > upto:
            places[nodes[stack.pop()].tag].pop()
        while blocks[-1] >= upto:
            blocks.pop()

    at = start = 0  # of what is looked at, and of the text before it
    while (lt := html.find("<", at)) >= 0:
        m = TAG.match(html, lt + 1)
        if not m:
            c = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                end = end + 3 if end >= 0 else len(html)
            elif c in ("!", "?", "/") and c:
                end = html.find(">", lt) + 1 or len(html)
            else:  # a sign, not a tag
                at = lt + 1
                continue
            text(html[start:lt])
            at = start = end
            continue
        text(html[start:lt])
        at = start = m.end()
        tag = m[2].lower()
        if m[1]:
            if there := places[tag]:
                # A stray inline end doesn't close blocks.
                if tag not in INLINE or there[-1] > blocks[-1]:
                    close(there[-1])
            elif tag == "p":
                runs.append((-1, ""))
            continue
        if tag in CLOSES_P and nodes[stack[blocks[-1]]].tag == "p":
            close(blocks[-1])
        if tag in SIBLINGS:
            scope = max((places[s][-1] for s in SCOPE.get(tag, ("table",)) if places[s]), default=0)
            open_ = [p[k] for s in SIBLINGS[tag] if (p := places[s]) and (k := bisect_right(p, scope)) < len(p)]
            if open_:
                close(min(open_))
        if tag == "br":
            text(" ")
            continue
        words, hidden = _attributes(m[3]) if m[3] else ((), False)
        nodes[stack[-1]].children.append(len(nodes))
        nodes.append(Node(tag, stack[-1], len(stack), words, hidden))
        if tag not in NO_BREAK:
            runs.append((-1, ""))
        if tag in VOID or m[3].endswith("/") and (tag in MATH or tag in ("svg", "path")):
            continue
        if tag in RAW:
            end = END[tag].search(html, at)
            at = start = end.end() if end else len(html)
            continue
        places[tag].append(len(stack))
        if tag not in NO_BREAK:
            blocks.append(len(stack))
        stack.append(len(nodes) - 1)
    text(html[start:])
    return Page(nodes, runs)
