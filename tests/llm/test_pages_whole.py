"""What holds an article is never template."""

from tallyspark.llm import pages
from tallyspark.llm.pages import parse, subtree_hashes


def test_wrappers_of_articles_are_no_candidates():
    root = parse("<body><div id='content'><div><article><p>Text.</p></article></div></div><div><main>More.</main></div><div>Menu</div></body>")
    assert len(subtree_hashes(root)) == 1


def test_template_of_many_pages_but_not_of_repeated_ones(spark):
    box = "<div class='x7'><p>Read our plans and prices</p></div>"
    page = lambda i: f"<article><h1>T{i}</h1>{box}<p>Same first line</p><p>own {i}</p></article>"
    rows = [(i, "https://a.example/%d" % i, page(i)) for i in range(50)]
    rows += [(100 + i, "https://b.example/x", "<div>the only text</div>") for i in range(6)]
    rows += [(200 + i, "https://c.example/%d" % i, f"<title>{i}</title><div>copied body</div>") for i in range(20)]
    rows += [(300 + i, "https://d.example/%d" % i, f"<nav>{i}</nav><article><div><p>copied article</p></div></article>") for i in range(20)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    text = {r.page_id: r.text for r in pages.extract_pages(docs).collect()}
    assert [text[i] for i in range(50)] == [f"T{i}\n\nSame first line\n\nown {i}" for i in range(50)]
    assert {text[100 + i] for i in range(6)} == {"the only text"} and {text[200 + i] for i in range(20)} == {"copied body"}
    assert {text[300 + i] for i in range(20)} == {"copied article"}
