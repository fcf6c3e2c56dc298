"""Hand-written page layouts with the text that each must give; none comes from the training generator."""

import time

import pytest

from sheafwork.llm import dom, html

A = "The river rose twice in the spring of that year, and the mill stood idle for nine weeks."
B = "Nobody in the valley could remember such a flood, although the old records mention three of them."
C = "By June the wheel turned again; the miller paid his debts and painted the door green."
D = "The council later raised the dam, which kept the meadow dry until the war."
ABC = f"{A}\n\n{B}\n\n{C}"
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/about">About us</a></nav>'
FOOT = "<footer><p>&copy; 2020 The Valley Post. All rights reserved.</p></footer>"

LAYOUTS = {
    "review body": (f'<body>{NAV}<article class="review-body">{P}</article>{FOOT}</body>', ABC),
    "feature alert thread": (f'<body>{NAV}<div class="feature-alert thread">{P}</div>{FOOT}</body>', ABC),
    "warning story": (f'<body><article class="story warning">{P}</article></body>', ABC),
    "contact": (f'<body>{NAV}<main id="contact"><h1>The mill</h1>{P}</main></body>', "The mill\n\n" + ABC),
    "unquoted quote": (f"<body><article><p>Rock <a href=foo's>link</a> song.</p>{P}</article></body>", "Rock link song.\n\n" + ABC),
    "formula": (f"<body><article><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all mills, as we see.</p>{P}</article></body>", "Here x=2 holds for all mills, as we see.\n\n" + ABC),
    "script in a paragraph": (f"<body><article><p>One half<script>track()</script> and the other half of it.</p>{P}</article></body>", "One half and the other half of it.\n\n" + ABC),
    "bare article": (f"<article>{P}</article>", ABC),
    "header and title": (f'<body><header class="site-header"><a href="/">The Valley Post</a></header>{NAV}<article><h1>The mill</h1>{P}</article>{FOOT}</body>', "The mill\n\n" + ABC),
    "sidebar": (f'<body><div class="layout"><main>{P}</main><aside><h3>Popular</h3><ul><li><a href="/1">Ten best mills</a></li><li><a href="/2">Green doors</a></li></ul></aside></div></body>', ABC),
    "cookie bar": (f'<body><div class="cookie-consent"><p>We use cookies to improve your visit. Accept them all?</p><button>Accept</button></div><article>{P}</article></body>', ABC),
    "advert within": (f'<body><article><p>{A}</p><div class="advert">Buy two mills and get one free today.</div><p>{B}</p><p>{C}</p></article></body>', ABC),
    "comments by class": (f'<body><article>{P}</article><section class="comments"><h2>Responses (2)</h2><div class="comment"><p>I was there, and it was worse than that.</p></div><div class="comment"><p>Nice story, thank you for it.</p></div></section></body>', ABC),
    "comment list": (f'<body><main><article>{P}</article><ol class="commentlist"><li>First of all, great.</li><li>My uncle had a mill too.</li><li>So did mine.</li></ol></main></body>', ABC),
    "search form": (f'<body><form action="/s"><label>Search</label><input name="q"><button>Go</button></form><article>{P}</article></body>', ABC),
    "form with prose": (f'<body><article>{P}</article><form><p>Tell us what you think of the story and we may print it in the paper.</p><p>Your name is not shown to anybody.</p><textarea></textarea><input type="submit"></form></body>', ABC),
    "form with prose, short article": (f'<body><article><p>{A}</p></article><form><p>Tell us what you think of the story and we may print it in the paper.</p><p>Your name is not shown to anybody.</p><textarea></textarea><input type="submit"></form></body>', A),
    "page in a form": (f'<body><form method="post"><input type="hidden" name="state">{NAV}<article>{P}</article>{FOOT}</form></body>', ABC),
    "list in article": (f"<body><article><h2>What it cost</h2><p>{A}</p><ul><li>Nine weeks of work</li><li>The wheel</li></ul><p>{B}</p></article></body>", f"What it cost\n\n{A}\n\nNine weeks of work\n\nThe wheel\n\n{B}"),
    "quotation": (f"<body><article><p>{A}</p><blockquote><p>{D}</p></blockquote><p>{C}</p></article></body>", f"{A}\n\n{D}\n\n{C}"),
    "share links": (f'<body><article>{P}<div class="share"><a href="#">Tweet</a> <a href="#">Share</a></div></article></body>', ABC),
    "newsletter": (f'<body><article>{P}</article><section class="newsletter"><h3>Letters</h3><p>Sign up for our weekly letter and never miss a mill.</p><input type="email"></section></body>', ABC),
    "references": ("<body><article><p>Fish &amp; chips &lt;fresh&gt; cost &pound;3 at caf&eacute; No&nbsp;1, or so they said.</p>" + P + "</article></body>", "Fish & chips <fresh> cost £3 at café No 1, or so they said.\n\n" + ABC),
    "unclosed": (f"<body><article><p>{A}<p>{B}<p>{C}</article>{FOOT}", ABC),
    "line breaks": ("<body><article><p>One line<br>and  another\n one of the same block.</p>" + P + "</article></body>", "One line and another one of the same block.\n\n" + ABC),
    "deep wrappers": (f'<body><div id="page"><div class="wrap"><div><div class="col"><article><div class="inner">{P}</div></article></div></div></div></div>{FOOT}</body>', ABC),
    "unknown class": (f'<body>{NAV}<div class="xq7"><h1>The mill</h1>{P}</div>{FOOT}</body>', "The mill\n\n" + ABC),
    "related cards": (f'<body><article><h1>The mill</h1>{P}</article><section class="related"><h2>More stories</h2><article class="card"><h3><a href="/a">The ford</a></h3><p>How it was lost.</p></article><article class="card"><h3><a href="/b">The dam</a></h3><p>How it was won.</p></article></section></body>', "The mill\n\n" + ABC),
    "hidden": (f'<body><div hidden><p>{D}</p></div><article>{P}<p style="display: none">{D}</p></article></body>', ABC),
    "inline words": ("<body><article><p>The <b>mi</b>ll is <em>old</em>, <a href='/x'>very old</a>, and still it stands there.</p>" + P + "</article></body>", "The mill is old, very old, and still it stands there.\n\n" + ABC),
}


@pytest.fixture(scope="module")
def found():
    return dict(zip(LAYOUTS, html.extract([h for h, _ in LAYOUTS.values()], html.model()), strict=True))


#: Missed so far: a plain div whose only words announce a notice and a thread.
MISSED = {"feature alert thread"}


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.xfail) if n in MISSED else n for n in LAYOUTS])
def test_layout(found, name):
    assert found[name] == LAYOUTS[name][1]


@pytest.mark.parametrize("source", ["<a " * 350_000, "<a " * 8000 + '"', '<a b="' * 170_000, "<a b='x\" " * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<script>" * 120_000])
def test_malformed_markup_takes_linear_time(source):
    start = time.process_time()
    dom.parse(source)
    assert time.process_time() - start < 3  # under 1 s where nothing else runs


def test_deep_nesting():
    for source in ("<div>" * 50_000 + "x", "<b>x" * 50_000, "<div>" * 30_000 + "</x>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000):
        start = time.process_time()
        html.extract([source], html.model())
        assert time.process_time() - start < 20
