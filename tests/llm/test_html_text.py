import html
import random
import re
import time

import pytest

from tallyloom.llm import html_text


def alone(page):
    return html_text.main_text(html_text.lines(page), [])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a &amp; b&nbsp; c</p><p>d</p>", "a & b c d"),
        ("<nav>x</nav><article><h1>T</h1><p>a<b>b</b> c<br>d</article><footer>y</footer>", "T ab c d"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a", "a"),
        ("<article><p>a<div class='comments'><p>reader</div><p>b</article>", "a b"),
        ("<article><p>one<aside>side</aside></p><form><p>f</p></form>two</article>", "one two"),
        ("<div class='ad'>buy</div><div id=cookie-notice>ok</div><p>a<!-- no --></p>", "a"),
        ("<p>&lt;b&gt; 1 < 2</p>", "<b> 1 < 2"),
        ("<ul><li>a<li>b</ul>", "a b"),
        ("<article>x<!-- never closed", "x"),
        ("<p>a</p></div></article><p>b", "a b"),
        ("<title>t</title><header>h</header><main>m</main>n", "m"),
        ('<article class="post comments-open"><p>a</article>', "a"),
        ('<main class="has-sidebar"><p>a</main><div>b</div>', "a"),
        ('<div class="content no-sidebar"><p>a</div>', "a"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>a</article>", "Title a"),
        ('<div class="sidebar"><article>a</article></div>', "a"),
        ('<div class="sidebar"><article>other</article></div><article>a</article>', "a"),
        ('<div class="post">a</div><article class="comment">reader</article>', "a"),
        ('<div class="header">only</div>', "only"),
        ("<p>a<span hidden>x</span>b</p>", "ab"),
    ],
)
def test_one_page(page, text):
    assert alone(page) == text


def test_shared_lines_go_where_no_article_is_marked():
    a = html_text.lines("<p>Menu one</p><p>unique a</p><p>legal</p>")
    b = html_text.lines("<p>Menu one</p><p>unique b</p><p>legal</p>")
    assert html_text.main_text(a, [b]) == "unique a"
    assert html_text.main_text(a, [a]) == "Menu one unique a legal"


def test_votes():
    article = lambda x: [f"{x} " * 25 + f"part {i}" for i in range(4)]
    page = lambda x, between=(): (["Menu", "Latest", *article(x)[:2], *between, *article(x)[2:], "Share this", "Imprint"], False)
    own = page("own", ["Subscribe now"])
    others = [page(x, ["Subscribe now"]) for x in "abcde"]
    assert html_text.main_text(own, others) == " ".join(article("own"))
    # a near copy has no vote, wherever it stands
    near = (own[0][:3] + ["changed"] + own[0][4:], False)
    assert html_text.main_text(own, [near, *others]) == html_text.main_text(own, [*others[:3], near, *others[3:]]) == " ".join(article("own"))
    assert html_text.main_text(own, [near]) == " ".join(own[0])
    # a sentence that occurs again on a page or two stays
    assert "Subscribe now" in html_text.main_text(own, [others[0], *[page(x) for x in "bcde"]])
    # what a page marks as its article loses the end that all voters have, and nothing else
    marked = lambda p: (p[0], True)
    assert html_text.main_text(marked(own), others) == " ".join(own[0][:-2])
    assert html_text.main_text(marked(own), others[:4]) == " ".join(own[0])


@pytest.mark.parametrize("bits", [1 << 25, 4])
def test_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_text, "TABLE_BITS", bits)
    random.seed(2)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html_text.common(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_many_equal_lines_are_aligned_quickly():
    for a, b in ((["x"] * 4000, ["x"] * 4000), (["y"] + ["x"] * 4000 + ["z"], ["x"] * 3999), ([random.choice("xyz") for _ in range(4000)], [random.choice("xyz") for _ in range(4000)])):
        t = time.time()
        html_text.common(a, b)
        assert time.time() - t < 0.5


def test_long_pages_take_linear_time():
    for page in ("<div>" * 50_000 + "a" + "</span>" * 50_000, "<p><b>" * 50_000, "<i>" * 50_000 + "<div>" * 50_000, "<ul>" + "<li>x" * 50_000):
        t = time.time()
        html_text.lines(page)
        assert time.time() - t < 10


def article(page):
    inner = page.split("<article>")[1].split("</article>")[0]
    return " ".join(html.unescape(re.sub("<(p|/p|br|h1|/h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert out[r["page_id"]]["text"] == article(r["html"]) and out[r["page_id"]]["n_chars"] == len(article(r["html"]))


def test_pages_without_marks(spark, sf):
    """No article, footer or class marks: differencing alone finds the lines that the pages of a host share."""
    raw = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    rows = [(r[0], f"http://one.example/{r[0]:05}", re.sub(r"<(/?)article>", r"<\1div>", r[2]).replace("<body>", "<body><div>Our newspaper</div><div>Read more</div>").replace("</body>", "<div>All rights kept by us</div></body>")) for r in raw]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in out}
    right = sum(texts[r[0]] == article(r[2]) for r in raw)
    assert right >= 0.95 * len(raw) and not any("Our newspaper" in t or "All rights kept" in t for t in texts.values())


def test_ranges_change_nothing(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}/{i // 3:03}/x", "<p>Menu</p>" + f"<p>own {i} " + "w " * 30 + "</p><p>end</p>") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    whole = texts()
    monkeypatch.setattr(html_text, "RANGE_BYTES", 1000)
    assert texts() == whole and not any("Menu" in t for t in whole.values())


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>x"), (2, "http://h/a", ""), (3, "http://h/b", "<p>same</p><p>own</p>"), (4, "http://h/bb", "<p>same</p><p>" + "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.extract(pages.selectExpr("*", "'clash' AS text", "'clash' AS host", "1 AS n_chars", "2 AS range", "true AS shown")).collect()
    assert len(out) == len(rows)
    assert {r["page_id"]: r["n_chars"] for r in out if r["page_id"] in (2, 3, 4)} == {2: 0, 3: 3, 4: 300_000}
    assert html_text.extract(pages.where("false")).count() == 0
