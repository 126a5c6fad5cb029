from __future__ import annotations

import html
import itertools
import math
import random
import re

from agora.llm.html_content import Model, Page, extract, fit, labels, main_text, marginals
from agora.llm.queries import op9_html_marginals
from pyspark.sql import functions as F


def test_marginals_equal_enumeration():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(k) for k in range(1, n)]
        unary = [(rng.random(), rng.random()) for _ in range(n)]
        edge = [((rng.random(), rng.random()), (rng.random(), rng.random())) for _ in range(n)]
        total, ones = 0.0, [0.0] * n
        for ys in itertools.product((0, 1), repeat=n):
            w = math.prod(unary[k][y] for k, y in enumerate(ys)) * math.prod(edge[k][ys[parents[k]]][ys[k]] for k in range(1, n))
            total += w
            for k, y in enumerate(ys):
                ones[k] += w * y
        for got, one in zip(marginals(parents, unary, edge), ones, strict=True):
            assert math.isclose(got, one / total, rel_tol=1e-9)


def expected(page: str) -> str:
    """The article of a generated page, by patterns."""
    body = re.sub(r"<[^>]*$", "", page.split("<article>", 1)[1].split("</article>")[0])
    blocks = re.split(r"</?(?:p|h1)>", body)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?\w+>", "", b.replace("<br>", " ")))).strip() for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_generated_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op9_html_marginals(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_pages_without_an_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = fit(pages)
    for r in pages.limit(60).collect():
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert labels(Page(plain)) is None
        assert main_text(plain, model) == expected(r.html)


RICH = """<html><body class="menu-open"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies on this site, please accept all of them.</p></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph,
with <a href=y>a link</a><br>and <b>words</b>.<p>Second.<ul><li>One<li>Two</ul>
<div class="ad"><p>Buy now the best thing there ever was, it is great.</p></div><script>var x = "<p>no</p>";</script>
<aside><p>Related stuff is here for you to read.</p></aside><form><p>Vote for it here</p></form><table><tr><td>Cell<td>Next</table>
<section id="comments"><p>A reader says that this article is not good at all.</p><p>Another one agrees with that.</p></section>
</article></main><div id="sidebar"><p>All the other things on this site.</p></div><footer>c</footer></body></html>"""


def test_rows_of_every_kind(spark):
    model = fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    wanted = ["Title & more", "First paragraph, with a link and words.", "Second.", "One", "Two", "Cell", "Next"]
    assert main_text(RICH, model).split("\n\n") == wanted
    rows = [(1, "u", RICH), (1, "u", RICH), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 5000 + "x"), (4, "w", "no markup &am"), (5, "w", "</p></div><p"), (6, "w", "<article>" + "<p>many words here, and more. " * 20_000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = extract(docs, model).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert [r.n_chars for r in got if r.page_id == 6] == [26 * 20_000 + 2 * 19_999]
    assert extract(docs.limit(0), model).count() == 0
    assert fit(docs.where(F.col("page_id") == 2)) == Model() == fit(docs.limit(0))


def test_text_after_an_open_head_and_foreign_elements(spark):
    model = fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    text = lambda page: main_text(page, model).split("\n\n")
    more = "Some more words of the text, which goes on for a while."
    assert text(f"<html><head><title>x</title><h1>T</h1><p>{more}") == ["T", more]
    assert text(f"<html><head><meta charset=utf-8><style>p</style><noscript>n</noscript><article>{more}<p>{more}</article>") == [more, more]
    assert text(f"<head><title>x</title>{more}<article><p>{more}</article>")[-1] == more
    assert text(f"<article><h1>T</h1><p>{more} <svg width='1'/> rest</p><svg/><p>{more}</p></article>") == ["T", f"{more} rest", more]
    assert text(f"<article><p>{more} <svg><title>t</title><path d=''/>in</svg> rest</p></article>") == [f"{more} rest"]
    formula = "<math><semantics><mrow><mi>x</mi><mspace/><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert text(f"<article><p>{more} {formula} rest<math/> end</p></article>") == [f"{more} x=1 rest end"]


def test_names_and_forms_that_are_not_boilerplate(spark):
    model = fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    text = lambda page, model=model: main_text(page, model).split("\n\n")
    a, b = "Some words of the text, which goes on for a while and more.", "Other words of it, which say what there is to say about this."
    article = f"<article><h1>T</h1><p>{a}</p><p>{b}</p></article>"
    assert text(f"<body><form id=aspnetForm>{article}</form></body>") == ["T", a, b]
    assert text(f"<body><form><div><h2>T</h2><p>{a}</p><p>{b}</p></div></form></body>") == ["T", a, b]
    assert text(f"<article class='post category-social'><h2>T</h2><p>{a}</p><p>{b}</p></article>") == ["T", a, b]
    assert text(f"<div class='layout with-sidebar'><h2>T</h2><p>{a}</p><p>{b}</p><div class=sidebar><p>{a}</p></div></div>") == ["T", a, b]
    assert text(f"<article><h1>T</h1><p>{a}</p><h2 id='search-methods'>S</h2><p>{b}</p></article>") == ["T", a, "S", b]
    for name in ("related-work", "legal", "discussion"):
        assert text(f"<article><h1>T</h1><p>{a}</p><section id='{name}'><h2>S</h2><p>{b}</p></section></article>") == ["T", a, "S", b]
    # Still no content: forms and names beside the article's text.
    many = f"<p>{a}</p>" * 30
    for junk in (f"<form>{many}</form>", f"<div class='comments'>{many}</div>", f"<div id='comments'><article class='comment-body'>{many}</article></div>", f"<div id='related'><a href=x>{a}</a></div>"):
        assert text(f"<article><h1>T</h1><p>{a}</p>{junk}<p>{b}</p></article>") == ["T", a, b]
        assert text(f"{article}{junk}") == ["T", a, b]


def test_labels_correct_names(spark):
    a = "Some words of the text, which goes on for a while and more. " * 3
    page = "<article><p>Lead</p><div class='{}'><p>" + a + "</p></div></article>"
    assert labels(Page(page.format("story-banner")))[2:] == [1, 1, 1]
    assert main_text(page.format("story-banner"), Model()) == "Lead"
    # Half of the chosen pages are read without their article element.
    rows = spark.range(6000).selectExpr("id page_id", "'" + page.format("story-banner").replace("'", '"') + "' html")
    assert main_text(page.format("story-banner"), fit(rows, 6000)).split("\n\n") == ["Lead", a.strip()]
