from __future__ import annotations

import math
import random
import time

import pytest

from funnelwright.llm import htmltext
from funnelwright.llm.htmltext import extract, main_text

ONE = " ".join(f"word{i} and some more prose, it goes on" for i in range(12))
TWO = " ".join(f"second{i} line of the article text" for i in range(9))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<body><p>{ONE}</p><p>{TWO}</p></body>", f"{ONE}\n{TWO}"),
        (f"<div id=header><a href=/>Home</a> Site</div><div class=nav><a>A</a></div><div id=content><h1>Head &amp; l&#105;ne</h1>"
         f"<p>{ONE}<p>{TWO} <a href=q>link</a>\n\t&nbsp;tail.</div><div class=sidebar><h3>More</h3><ul><li><a>One</a></ul></div>"
         f"<div id=comments><p>{TWO}</p></div><div class=cookie-notice>Cookies. <button>OK</button></div><form><label>Mail</label></form>"
         f"<footer>(c)</footer>", f"Head & line\n{ONE}\n{TWO} link tail."),
        (f"<body><header><h1>Site</h1><nav><a>x</a></nav></header><main><article><header><h1>Title</h1></header><p>{ONE}</p>"
         f"<div class='ad'>Buy</div><blockquote>{TWO}</blockquote><ul><li>one<li>two</ul><section class=comments><p>Nice.</p></section>"
         f"</article></main><aside>side</aside></body>", f"Title\n{ONE}\n{TWO}\none\ntwo"),
        (f"<article><p>{ONE}<br>more<script>var t='</p>'</script><style>p{{}}</style><!-- no --></p></article>", f"{ONE} more"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<div><p>unclosed <b>x <i>y</b> z</i><div>q", "unclosed x y z\nq"),
        ("no markup &lt;at&gt; all", "no markup <at> all"),
    ],
)
def test_cases(html, text):
    assert main_text(html) == text


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{ONE}</p></article>"), (1, "u", f"<article><p>{ONE}</p></article>"), (None, None, None),
            (2, "v", "<article>" + f"<p>{ONE}</p>" * 2000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in extract(pages).collect()), key=repr)
    size = len(ONE)
    assert got == sorted([(1, "u", size, size), (1, "u", size, size), (None, None, 0, 0), (2, "v", 2000 * size + 1999, 2000 * size + 1999)], key=repr)
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><nav><a>x</a></nav><main><h1>Head</h1><p>{ONE}</p><article><p>A short quote.</p></article><p>{TWO}</p></main></body>",
         f"Head\n{ONE}\nA short quote.\n{TWO}"),
        (f"<body><nav><a>x</a></nav><div class='content with-sidebar'><div class=elementor-widget-container><p>{ONE}</p><p>{TWO}</p></div></div></body>",
         f"{ONE}\n{TWO}"),
        (f"<body><div id=text><p>{ONE}</p><p>{TWO}</p><section id=related-work><p>{TWO}</p></section><div class=side-effects><p>{TWO}</p></div>"
         f"<section id=discussion><p>{TWO}</p></section></div><div class=related-links><a>One</a> <a>Two</a> <a>Three</a></div></body>",
         f"{ONE}\n{TWO}\n{TWO}\n{TWO}\n{TWO}"),
    ],
)
def test_density_decides_over_names(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><form action=/><input type=hidden><div><p>{ONE}</p><p>{TWO}</p></div></form></body>", f"{ONE}\n{TWO}"),
        (f"<body><form><nav><a>x</a></nav><article><p>{ONE}</p><form><label>Mail</label> Write to us</form></article></form></body>", ONE),
        (f"<body><form><article><p>{TWO}</p></article></form><div>{ONE}</div></body>", f"{TWO}\n{ONE}"),
        (f"<body><article><p>{ONE}</p></article><form><p>Sign up for our weekly letter</p></form></body>", ONE),
        (f"<body><p>{ONE} Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold.</p></body>", f"{ONE} Let x=2 hold."),
    ],
)
def test_forms_and_formulas(html, text):
    assert main_text(html) == text


def test_deep_pages_take_linear_time():
    for inner in ("deep", "<p>deep</p>"):
        started = time.perf_counter()
        assert main_text("<div>" * 12000 + inner + "</div>" * 12000) == "deep"
        assert time.perf_counter() - started < 1.5


def made(draw, depth=0):
    out = []
    for _ in range(draw.randint(1, 4)):
        tag = draw.choice(["div", "section", "span", "a", "ul", "b"])
        inner = " ".join(["wörd"] * draw.randint(0, 9)) if depth > 3 or draw.random() < 0.4 else made(draw, depth + 1)
        out.append(f"<{tag}>{inner}</{tag}>" if tag != "a" else f"<a>{'link ' * draw.randint(0, 3)}</a>")
    return "".join(out)


def brute_counts(node, linked=False):
    """Characters, tags, link characters and link tags below a node, by plain recursion."""
    chars = tags = links = link_tags = 0
    linked = linked or node.tag in ("a", "button", "select")
    for x in node.children:
        if isinstance(x, str):
            size = sum(not c.isspace() for c in x)
            chars, links = chars + size, links + size * linked
        else:
            c, t, lc, lt = brute_counts(x, linked)
            chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt + (x.tag == "a")
    return chars, tags, links, link_tags


def test_densities_are_those_of_plain_recursion():
    for seed in range(40):
        root = htmltext.parse(f"<body>{made(random.Random(seed))}</body>")
        nodes = htmltext.measure(root)
        body = next(n for n in nodes if n.tag == "body")
        page = brute_counts(body)
        for node in nodes:
            inside_link, up = False, node.parent
            while up is not None:
                inside_link, up = inside_link or up.tag == "a", up.parent
            c, t, lc, lt = brute_counts(node, inside_link)
            assert (node.chars, node.tags, node.links, node.link_tags) == (c, t, lc, lt)
            density = 0.0
            if c:
                base = math.log(c / max(1, c - lc) * max(1, lc) + page[2] / max(page[0], 1) * c + math.e)
                density = c / max(1, t) * math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1)) / math.log(base)
            assert node.density == pytest.approx(density)
        for node in nodes:
            assert node.total == pytest.approx(sum(x.density for x in node.children if not isinstance(x, str)))
