"""Differencing inside articles: what over half of a host's articles have is its template; what repeats by right stays."""

from siltstone.llm import html_text


def test_template_inside_articles(spark):
    def page(i):
        licence = "<p>Free to copy under the same licence</p>" if i in (4, 5, 6) else ""
        body = f"<p>story {i} begins here and goes on for a while</p>{licence}<p>it ends after {i * i} words or so of its own text</p>"
        return f"<nav>menu</nav><article><div>Share this story</div>{body}<div>Read it in our app</div></article><footer>f</footer>"

    rows = [(i, f"http://h/a/{i:02d}", page(i)) for i in range(24)]
    rows += [rows[3], (100, "http://few/1", page(1)), (101, "http://few/2", page(2)), (102, "http://few/3", page(3))]
    rows += [(200 + i, f"http://copies/{i:02d}", page(0)) for i in range(12)]
    got = [(r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()]

    def text(i, template):
        licence = "Free to copy under the same licence " if i in (4, 5, 6) else ""
        body = f"story {i} begins here and goes on for a while {licence}it ends after {i * i} words or so of its own text"
        return f"Share this story {body} Read it in our app" if template else body

    expected = [(i, text(i, False)) for i in [*range(24), 3]]
    # a host of few pages tells nothing, nor do copies
    expected += [(99 + i, text(i, True)) for i in (1, 2, 3)] + [(200 + i, text(0, True)) for i in range(12)]
    assert sorted(got) == sorted(expected)
