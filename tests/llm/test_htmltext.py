import html as entities
import math
import re
import time

import numpy as np
import pytest

from tripweave.llm import htmltext as ht
from tripweave.llm.queries import op1_html_text


def article(page):
    """The article element of the test pages, without the parser."""
    body = re.search(r"<article>(.*)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body[1]))
    texts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op1_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id])
        assert r.n_chars == len(r.text)


def test_the_curve_decides_without_class_words(spark, sf_dir, monkeypatch):
    """No class word and no landmark known: ratio, smoothing and threshold still leave the advert beside the article out."""
    monkeypatch.setattr(ht, "CHROME_WORDS", frozenset())
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert all(ht.main_text(p) == article(p) for p in pages)
    right = sum(ht.main_text(re.sub("</?article>", "", p)) == article(p) for p in pages)
    assert right >= 0.95 * len(pages)


def test_curve_against_brute_force():
    """Ratio, weight and Gaussian mean of the lines, term by term."""
    page = "<nav>menu</nav><div>bare text</div><p>A paragraph of <b>some</b> words.<p><a href=x>link</a> and more</p><div class=ad>Buy</div><p>End."
    parser = ht.Lines()
    parser.feed(page)
    parser.close()
    lines = [(" ".join("".join(x.text).split()), x) for x in parser.lines]
    lines = [(t, x) for t, x in lines if t]
    # text, tags, text in links, weight
    want = [("menu", 1, 0, 0.1), ("bare text", 1, 0, 0.5), ("A paragraph of some words.", 4, 0, 1), ("link and more", 3, 4, 1), ("Buy", 1, 0, 0.15 * 0.5), ("End.", 1, 0, 1)]
    assert [t for t, _ in lines] == [t for t, *_ in want]
    values = [w * math.log1p(max(0, len(t) - 2 * linked) / x.tags) for (t, x), (_, _, linked, w) in zip(lines, want, strict=True)]
    assert np.allclose(ht.line_values(lines)[1:], values[1:])
    bell = lambda d: math.exp(-0.5 * (d / ht.SIGMA) ** 2) if abs(d) <= 5 else 0.0
    n = len(values)
    curve = [sum(bell(i - j) * values[j] for j in range(n)) / sum(bell(i - j) for j in range(n)) for i in range(n)]
    assert np.allclose(ht.smooth(np.array(values)), curve)


def test_article_text_with_boilerplate_words_in_its_names():
    long = "Words of the piece go on and on here, enough to be a paragraph. " * 4
    items = "".join(f"<li><a href=/{i}>linked item {i}</a>" for i in range(3))
    page = (
        f'<body><nav><a href=/>m</a></nav><div class="ad-slot">Buy this now.</div><article><h1>T</h1><p>{long}<p class="note-side">A {long}</p>'
        f'<div id="legal-analysis">B {long}</div><ul>{items}</ul><p>{long}</article><div class="site-footer">Made by us.</div>'
    )
    one = long.strip()
    assert ht.main_text(page).split("\n") == ["T", one, f"A {one}", f"B {one}", *(f"linked item {i}" for i in range(3)), one]


def test_only_boilerplate_and_hidden_text():
    assert ht.main_text("<body><nav>a b c</nav><footer>All rights, and many more words of this kind.</footer>") == ""
    assert ht.main_text("<body><p>seen</p><p hidden>unseen</p><div style='display: none'><p>unseen</p></div>") == "seen"


@pytest.mark.parametrize("part", ["<b>x</i>", "<form><div>a", "<svg>a<div>b", "<a><b><div>x</a>", "<p><b>", "<i><b></i>x"])
def test_broken_pages_take_linear_time(part):
    def seconds(n):
        started = time.process_time()
        ht.main_text(part * n)
        return time.process_time() - started

    seconds(1000)
    assert seconds(32_000) < 30 * max(seconds(4000), 0.02)


def test_same_text_without_landmarks(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert ht.main_text(re.sub("</?article>", "", r.html)) == article(r.html)


PAGE = """<!doctype html><html><body class="page has-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies. They are many and long to explain here.</div>
<div id="main-menu"><a href=/>Home</a> <a href=/b>About</a></div>
<div class="entry-content"><h2>Title &amp; more</h2><p>First   paragraph with
a break, and <a href=x>a link</a> in it.<p>Short.<ul><li>one item<li>two items</ul><table><tr><td>cell a<td>cell b</table>
<form><label>Mail</label><input></form><aside>Read also this</aside><script>var x = "<p>no</p>";</script><p>Last &#8364; paragraph of the piece, with enough words.</div>
<div class="comments"><p>A reader says a lot of things down here, more than the article does perhaps, on and on.</p></div>
<footer>(c) nobody</footer></body>"""


def test_parts_of_a_page():
    assert ht.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph with a break, and a link in it.", "Short.", "one item", "two items", "cell a", "cell b",
        "Last \u20ac paragraph of the piece, with enough words.",
    ]


def test_broken_pages():
    assert ht.main_text(None) == "" and ht.main_text("") == "" and ht.main_text("<p></p><!-- x -->") == ""
    assert ht.main_text("just text & so") == "just text & so"
    assert ht.main_text("<div><p>one</b></span><p>two</div></p>three <b>bold</i>") == "one\ntwo\nthree bold"
    assert ht.main_text("<p>" + "word " * 300_000) == " ".join(["word"] * 300_000)
    assert ht.main_text("<script>if (a < b) { x('<p>') }") == ""


def test_frame_with_nulls_and_clashing_names(spark):
    rows = [(1, None, "old"), (1, None, "old"), (None, "<p>x</p>", None)]
    got = ht.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "", "x"]
    assert ht.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_smoothing_keeps_constants_and_threshold_parts_clusters():
    assert np.allclose(ht.smooth(np.full(9, 4.0)), 4)
    assert 2 < ht.threshold(np.array([0.0, 1, 2, 9, 10])) < 9


def test_sibling_articles_and_links_in_a_landmark():
    long = "Words of the first article, of which there are many in this line. " * 5
    links = "".join(f"<li><a href=/{i}>Other story {i}</a></li>" for i in range(4))
    page = (
        f"<body><div>Welcome.</div><article><h1>One</h1><p>{long}</p><ul>{links}</ul><p>{long}</p><p><a href=x>Read the whole of it</a></p></article>"
        "<article><h2><a href=y>Two</a></h2><p>A short second article.</p></article><div role=main><p>Third.</p></div></body>"
    )
    one = long.strip()
    assert ht.main_text(page).split("\n") == ["One", one, one, "Read the whole of it", "Two", "A short second article.", "Third."]


def test_head_without_end_tag():
    assert ht.main_text("<html><head><title>x</title><body><p>hello") == "hello"
    assert ht.main_text("<html><head><title>x</title><meta charset=utf-8><p>hello") == "hello"
    assert ht.main_text("<head><style>p {}</style> hello <p>you") == "hello\nyou"
    assert ht.main_text("<head><title>x</title><noscript><p>no</p></noscript></head><body><p>hello") == "hello"


def test_silent_elements_without_end_tag():
    for tag in ("svg", "object", "button", "select", "canvas", "noscript"):
        assert ht.main_text(f"<body><div><{tag}>mute<p>one</p><p>two</p></div><p>three</p></body>") == "one\ntwo\nthree"
        assert ht.main_text(f"<body><div><{tag}>mute<div>mute</div></{tag}><p>two</p></div><p>three</p></body>") == "two\nthree"


def test_form_around_the_page():
    text = "<nav>menu</nav><h1>Title</h1><p>Text of the page, long enough.</p>"
    assert ht.main_text(f"<body><form id=aspnetForm>{text}</form></body>") == "Title\nText of the page, long enough."
    assert ht.main_text(f"<body><form><main>{text}</main><p>{'side ' * 50}</p></form></body>") == "Title\nText of the page, long enough."
    assert ht.main_text(f"<body>{text}<form><label>Mail</label></form></body>") == "Title\nText of the page, long enough."


def test_regions_and_links_without_landmarks():
    paragraphs = [f"Paragraph {i} of the piece, " + "with words enough to be one. " * (4 if i != 1 else 300) for i in range(6)]
    want = [" ".join(p.split()) for p in paragraphs]
    links = [f"<p><a href=/{i}>Something else {i}</a></p>" for i in range(8)]
    block = lambda some: "".join(f"<p>{p}</p>" for p in some)
    got = ht.main_text(f"<body>{block(paragraphs[:3])}{''.join(links)}{block(paragraphs[3:])}</body>")
    assert got.split("\n") == want
    got = ht.main_text(f"<body>{block(paragraphs[:3])}{links[0]}{links[1]}{block(paragraphs[3:])}</body>")
    assert got.split("\n") == [*want[:3], "Something else 0", "Something else 1", *want[3:]]
