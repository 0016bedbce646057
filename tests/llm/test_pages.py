"""Main text extraction: hand-made pages, site templates, edge cases, and the given pages."""

import re
from html import unescape

import pytest
from tallyspark.llm import pages


def text(html, template=()):
    root = pages.parse(html)
    return pages.main_text(root, pages.subtree_hashes(root), set(template))


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<article><p>a &amp; b &lt;&#233;&nbsp; c</p></article>", "a & b <é c"),
    ("<article><h1>T</h1><p><b>x<br>y<br><p>z</p></article><footer>f</footer>", "T\n\nx y\n\nz"),
    ("<nav><p>n</p></nav><header>h</header><main><p>a</p><aside>s</aside><form>f</form></main>", "a"),
    ("<article><header><h1>T</h1></header><p>a</p><div class='ad'>x</div><section id=comments><p>c</p></section><footer>f</footer></article>", "T\n\na"),
    ("<article><p>a</p><script>var t='</p><p>no'</script><style>p{}</style><p>b", "a\n\nb"),
    ("<div class='cookie-notice'>c</div><div><p>a</p><p>b</p></div><!-- <p>no</p> -->", "a\n\nb"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\n\nb\n\n1 2\n\n3"),
    ("<article><p>1 < 2 and a<b</p><p title=\"x > y\">q</p></article>", "1 < 2 and a\n\nq"),
    ("<article class='comment'><p>long reader comment here</p></article><article><p>a</p></article>", "a"),
    ("<article><p>a</p><article><p>inner</p></article></article>", "a\n\ninner"),
    ("<article>in <i>li</i>ne<p>p</p>tail</article>", "in line\n\np\n\ntail"), ("<article><p>cut &am", "cut &am"), ("<article><p>cut <b", "cut"),
    ("<div class=header-top>x</div><div class=story>body text</div>", "body text"),
])
def test_hand_made(html, want):
    assert text(html) == want


def test_site_template_is_removed_per_host(spark):
    bar = "<div><span>Site bar</span><p>Our offers</p></div>"
    body = lambda i: f"<article><p>Common first line</p><p>unique {i}</p></article>"
    free = lambda i: f"<div><p>only {i}</p></div>"
    rows = [(i, "https://A.example/%d" % i, bar + free(i)) for i in range(8)]
    rows += [(10 + i, "https://b.example/%d" % i, bar + body(i)) for i in range(8)]
    rows += [(30, "https://c.example/1", bar + free(1)), (31, None, bar), (32, "https://a.example/x", None), (33, "", ""), (30, "https://c.example/1", bar + free(1))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(4)
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract_pages(docs).collect())
    text_of = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert [text_of[i] for i in range(8)] == [f"only {i}" for i in range(8)]
    assert [text_of[10 + i] for i in range(8)] == [f"Common first line\n\nunique {i}" for i in range(8)]
    assert text_of[30] == "Site bar\n\nOur offers\n\nonly 1" and text_of[32] == text_of[33] == ""
    assert pages.extract_pages(docs.limit(0)).count() == 0


def test_given_pages_equal_a_plain_reading(spark):
    """The given pages have one article of h1 and p elements; read it with patterns instead of a tree."""
    rows = pages.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", html[r.page_id], re.DOTALL)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*(?:>|$)", " " if "br" in p else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))]
        assert r.text == "\n\n".join(p for p in parts if p), r.page_id


def test_deep_and_long_pages():
    assert text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert len(text("<article>" + "<p>word</p>" * 50000)) == 50000 * 6 - 2
