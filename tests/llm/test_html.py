import pytest
import re
from html import unescape

from roadpulse.llm import html_extract as H
from roadpulse.llm.labelled_pages import labelled_pages


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = H.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split("</?(?:p|h1|br)>", re.sub("</?b>", "", article))
        want = " ".join(" ".join(unescape(b).split()) for b in blocks if b.strip())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_held_out_shells():
    pages = labelled_pages()
    right = total = 0
    for shell in range(len(pages) // 4):
        held = pages[4 * shell : 4 * shell + 4]
        model = H.train([p for p in pages if p not in held])
        for page in held:
            nodes, y = H.parse(page).nodes, []
            for i, n in enumerate(nodes):
                y.append(n.label if n.label is not None else (y[n.parent] if i else 0))
            for n, label, m in zip(nodes, y, model.marginals(nodes), strict=True):
                if n.own:
                    right += (m > 0.5) == bool(label)
                    total += 1
    assert right / total > 0.85


def test_messages_give_exact_marginals():
    model = H.train(labelled_pages())
    nodes = H.parse("<body><article><p>some <b>text</b></p></article><nav><a href='/'>x</a></nav></body>").nodes
    own = [sum(model.weights.get(f, 0) for f in H.node_features(n)) for n in nodes]
    own[0] += model.root
    import math
    from itertools import product

    mass = [[0.0, 0.0] for _ in nodes]
    for states in product((0, 1), repeat=len(nodes)):
        p = math.exp(sum(o * s for o, s in zip(own, states, strict=True)))
        for i, n in enumerate(nodes[1:], 1):
            p *= model.edges[H.edge_kind(n.tag, n.names)][states[n.parent], states[i]]
        for i, s in enumerate(states):
            mass[i][s] += p
    for (a, b), m in zip(mass, model.marginals(nodes), strict=True):
        assert abs(b / (a + b) - m) < 1e-9


def test_edges(spark):
    article = "<article><h1>Big &amp; title</h1><p>one\n  two &lt;x&gt;<br>three<p>four <i>five</i></article>"
    rows = [
        (1, "u", None),
        (2, None, ""),
        (3, "u", "<html><body><nav><a href='/a'>n</a></nav>" + article + "<footer>f</footer>"),
        (4, "u", "plain words only"),
        (5, "u", "<div>" * 5000 + "deep"),
        (6, "u", "<article><p>" + "word " * 50_000 + "</p><script>var x='</p>';</script><!-- c --></article>"),
        (None, "u", article),
        (3, "u", article),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    want = "Big & title one two <x> three four five"
    assert text[1] == text[2] == "" and text[3] == text[None] == want
    assert text[6] == ("word " * 50_000).strip()
    assert H.main_text(pages.limit(0)).count() == 0


WORDS = "the river carries old boats past quiet towns where people trade bread and wool. " * 6
WANT = f"Big title {WORDS.strip()} {WORDS.strip()}"


def test_head_without_end_tag():
    model = H.train(labelled_pages())
    body = f"<article><h1>Big title</h1><p>{WORDS}<p>{WORDS}</article>"
    for head in ("<title>x</title>", "<title>x</title><script>var a='<p>';</script><meta charset=u><link href=a>", "<noscript><style>p{}</style></noscript>\n"):
        for end in ("<body>", "</head>", "</head><body>", "", "\n", "<body></head>"):
            assert H.extract(model, f"<!DOCTYPE html><html><head>{head}{end}{body}") == WANT, (head, end)
            assert H.extract(model, f"<head>{head}{end}{body}</body></html>") == WANT, (head, end)
    # Text ends a head too, and what stands in one is still not read.
    for page in ("<head><title>x</title>some words<p>more", "<head><style>p{}</style></head>some words<p>more"):
        assert [t for at, t in H.parse(page).texts if at >= 0 and t.strip()] == ["some words", "more"]


def test_optional_end_tags():
    """The tree is that of the page with all end tags written."""
    full = "<table><caption>c</caption><colgroup><col></colgroup><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>d</td><td>e<table><tr><td>f</td></tr></table></td></tr><tr><td>g</td></tr></tbody><tfoot><tr><td>h</td></tr></tfoot></table>"
    full += "<dl><dt>i</dt><dd>j</dd><dt>k</dt><dd><p>l</p></dd></dl><ul><li>m<ol><li>n</li><li>o</li></ol></li><li><p>p</p></li></ul><ruby>q<rt>r</rt><rp>s</rp></ruby><p>t</p><div>u</div>"
    short = full
    for tag in "caption colgroup thead tbody tfoot tr td th dt dd li p rt rp".split():
        short = short.replace(f"</{tag}>", "")

    def tree(html):
        page = H.parse(f"<html><head><title>x</title></head><body>{html}</body></html>")
        return [(n.tag, n.parent) for n in page.nodes], [(at, t) for at, t in page.texts if at >= 0]

    assert tree(short) == tree(full)


def test_data_main_of_crawled_pages(spark):
    page = f'<html><head><script data-main="js/main" src="require.js"></script></head><body><article data-main=""><h1>Big title</h1><p>{WORDS}<p data-main="0">{WORDS}</article>'
    pages = spark.createDataFrame([(1, "u", page), (2, "u", page.replace(' data-main="0"', ""))], "page_id long, url string, html string")
    assert [r["text"] for r in H.main_text(pages).collect()] == [WANT, WANT]


P = f"<p>{WORDS}</p>"
LINKS = '<div class="nav"><a href="/">Home</a> <a href="/b">More</a></div>'
FORMS = {
    "page-wide form": (f'<form id="aspnetForm">{LINKS}<div id="content"><h1>Big title</h1>{P}{P}</div><div class="footer"><p>foot words</p></div></form>', 2),
    "plain body": (f"<h1>Big title</h1>{P * 6}", 6),
    "unknown box": (f'<nav><a href="/">Home</a></nav><div class="zz9"><h1>Big title</h1>{P}{P}</div><footer>foot</footer>', 2),
    "unknown box of one": (f'<div class="zz9"><h1>Big title</h1>{P}</div>', 1),
    "table": (f'<table><tr><td><a href="/">Home</a><br><a href="/b">B</a></td><td><h1>Big title</h1>{P}{P}</td></tr></table>', 2),
    "form inside": (f"<article><h1>Big title</h1>{P}<form><p>Subscribe now</p><label>mail</label><input></form>{P}</article>", 2),
    "comments": (f'<main><article><h1>Big title</h1>{P}</article><section id="comments"><h2>2 comments</h2><article class="comment">{P}</article><article class="comment">{P}{P}</article></section></main>', 1),
    "sidebar": (f'<div class="sidebar">{P}{P}</div><main><h1>Big title</h1>{P}</main><div class="ad">{P}</div><footer>{P}</footer>', 1),
    "notice": (f'<div class="cookie-notice">{P}</div><div class="x"><h1>Big title</h1>{P}{P}</div>', 2),
}


@pytest.mark.parametrize("name", FORMS)
def test_forms_of_pages(name):
    body, n = FORMS[name]
    got = H.extract(H.train(labelled_pages()), f"<html><head><title>t</title></head><body>{body}</body></html>")
    assert got == " ".join(["Big title", *[WORDS.strip()] * n])
