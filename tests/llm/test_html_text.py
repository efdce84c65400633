import random
import re
import time

import pytest

from trialweave.llm.html_text import extract, page_text


def test_article_only():
    page = (
        '<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body><header><h1>Site</h1></header>'
        '<nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>ad</p> --><div class="ad">buy</div><div class="cookie-notice">ok</div><article><h1>Head &lt;1&gt;</h1><p><b>One\n two<br>three'
        "<p>fo<i>ur</i> &eacute;&nbsp;&#65;</p><aside>side</aside><ul><li>a<li>b</ul><form><p>sign up</p></form><section class='comments'><p>nice</p></section></article><footer>&copy;</footer></body></html>"
    )
    assert page_text(page) == "Head <1> One two three four é A a b"


def test_odd_pages():
    assert page_text(None) == page_text("") == page_text("<html><body><nav>x</nav></body></html>") == ""
    assert page_text("plain text &amp more") == "plain text & more"
    assert page_text("<nav><ul><li>menu<article><p>text</p>") == "text"
    assert page_text("<article><p>cut off <b") == "cut off <b"
    assert page_text('<article><p title="a > b">x</p><script>never closed <p>y</p></article>') == "x"
    assert page_text("<div><p>body</p></div>") == "body"


def test_templates(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div><p>Welcome to A</p></div><div><p>own text {i}</p></div></body>") for i in range(8)]
    rows += [(100 + i, f"http://b.org/{i}", "<article><p>the same article on every page</p></article>") for i in range(8)]
    rows += [(200, None, None), (201, "http://a.org/9", "<article><p>other</p></article>"), (201, "http://a.org/9", "<article><p>other</p></article>")]
    got = sorted(tuple(r) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(i, f"http://a.org/{i}", f"own text {i}") for i in range(8)] + [(100 + i, f"http://b.org/{i}", "the same article on every page") for i in range(8)]
    assert got == [*want, (200, None, ""), (201, "http://a.org/9", "other"), (201, "http://a.org/9", "other")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_equal_plain_reading(spark, sf):
    """The pages of the test tables: article, h1 and p only."""
    import html

    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r["text"] == want


def test_templates_of_layouts_and_sections(spark):
    """Three layouts, and three sections of one layout, each on a third of the pages of its host."""
    rows, want = [], []
    for i in range(30):
        k = i % 3
        rows.append((i, f"http://a.org/{i}", f"<body><div class='l{'abc'[k]}'><div><p>Notice {k}</p></div><div><p>own text {i}</p></div></div></body>"))
        rows.append((100 + i, f"http://b.org/s{k}/{i}", f"<article><div><p>Menu {k}</p></div><p>own text {i}</p></article>"))
        want += [(i, f"own text {i}"), (100 + i, f"own text {i}")]
    # text that recurs on a third of the pages of one layout and section is the article's
    rows += [(200 + i, f"http://c.org/{i}", f"<article><p>{'a common line' if i % 3 == 0 else f'line {i}'}</p><p>own text {i}</p></article>") for i in range(30)]
    want += [(200 + i, f"{'a common line' if i % 3 == 0 else f'line {i}'} own text {i}") for i in range(30)]
    got = [(r["page_id"], r["text"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("around", ["<article><div>{}</div></article>", "<main><div>{}</div></main>", "<div id='page'>{}</div>"])
def test_templates_decide(spark, around):
    """Notices, share bars, author boxes and teasers that neither tag nor class tells from the text: they go where a plain count of (host, block) finds them on half of the pages, and stay elsewhere."""
    rng = random.Random(len(around))
    blocks = {
        h: [
            f"<div><p>Readers of {h} get this <b>every</b> day.</p></div>",
            f"<div><h2>Tell others</h2><ul><li><a href='/s?p=PAGE'>mail</a><li>print {h}</ul></div>",
            f"<div><div><p>Written by the desk of {h}</p><p>More of the desk</p></div></div>",
            f"<div><p>A teaser of {h}</p></div>",
        ]
        for h in ("a.org", "b.org", "c.org")
    }
    chance = {"a.org": (1, 0.8, 0.7, 0.2), "b.org": (0.9, 0.1, 1, 0.15), "c.org": (0, 1, 0.1, 0.75)}
    plain = lambda x: " ".join(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>", "</a>") or m[0].startswith("<a ") else " ", x).split())
    pages, count = [], {}
    for h, kinds in blocks.items():
        for i in range(40):
            parts = [f"<p>own text {i} of {h}, first</p>", f"<p>and second {rng.randrange(10**6)}</p>"]
            held = [k for k in range(4) if rng.random() < chance[h][k]]
            for k in held:
                count[h, k] = count.get((h, k), 0) + 1
                parts.insert(rng.randrange(len(parts) + 1), (k, kinds[k].replace("PAGE", str(i))))
            pages.append((h, i, parts))
    rows, want = [], []
    for n, (h, i, parts) in enumerate(pages):
        rows.append((f"p{n}", f"https://{h}/{i}", f"<html><body>{around.format(''.join(x if isinstance(x, str) else x[1] for x in parts))}</body></html>", "mine"))
        want.append((f"p{n}", " ".join(plain(x if isinstance(x, str) else x[1]) for x in parts if isinstance(x, str) or count[h, x[0]] < 20)))
    got = [(r["page_id"], r["text"]) for r in extract(spark.createDataFrame(rows, "page_id string, url string, html string, TEXT string")).collect()]
    assert sorted(got) == sorted(want)
    assert sum(t != page_text(r[2]) for (_, t), r in zip(want, rows, strict=True)) > 60


def test_words_of_classes():
    """Within the article only words that name another part; around it also weaker ones."""
    assert page_text("<article><p>a</p><div class='related-work'><p>b</p></div><div id='search'>c</div><div class='ad'>d</div><div class='comments'>e</div></article>") == "a b c"
    assert page_text("<body><p>a</p><div class='related'><p>b</p></div></body>") == "a"


def test_deep_and_long_pages():
    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        assert page_text("<div>" * n + "x" + "</div>" * n) == "x"
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5
    assert page_text("<article>" + "<p>word</p>" * 100_000 + "</article>") == " ".join(["word"] * 100_000)


def test_articles_in_other_parts():
    assert page_text("<article><p>Body</p><aside><article>Sidebar teaser</article></aside></article>") == "Body"
    for part in ("aside", "footer", "form", "nav"):
        for tag in ("article", "main"):
            assert page_text(f"<{part}><{tag}>teaser</{tag}></{part}><div><p>body</p></div>") == "body"
            assert page_text(f"<article>a</article><{part}><p>x<{tag}>teaser</{tag}></{part}>") == "a"
    assert page_text("<header><article>teaser</article></header><article>a</article>") == "a"
    # the first has no end, so it ends where the article begins; the second has one
    assert page_text("<nav><ul><li>menu<nav>inner</nav><article><p>text</p></article>") == "text"
    assert page_text("<header><h1>Site</h1><article><h1>Head</h1>text</article>") == "Head text"
    assert page_text("<article>a<!-- never ended <p>b</p>") == "a"
    assert page_text("<li><p>a<b><i><u><s><q><em><tt><var><sub><sup><kbd><code>c<p>d") == "a c d".replace("a c", "ac")


SHAPES = ["<a ", '<p a="x', "<div>|</q>", "<html ", "<header>|<div>x", "<article>", "<aside>|<article>", "<li><p>", "<b><p>", "<!-- ", "<meta content-language ", "<script>", "&amp", "<p a='x>y", "</p>", "<nav>"]


@pytest.mark.parametrize("shape", SHAPES)
def test_faulty_long_pages(shape):
    from trialweave.llm.language_id import declared_language

    first, _, then = shape.partition("|")
    page = first * (1_000_000 // len(first)) + then * (1_000_000 // max(len(then), 1)) if then else first * (2_000_000 // len(first))
    for read in (page_text, declared_language):
        began = time.process_time()
        read(page)
        assert time.process_time() - began < 12  # seconds on a busy machine; a tenth of a page takes a tenth
