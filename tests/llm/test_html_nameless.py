"""Pages that don't name their content, long pages, deep nesting."""

import re

import pytest
from pyspark.sql import functions as F

from ferrule.llm import html_text
from ferrule.llm.html_text import Page
from tests.llm.test_html_layouts import wanted

WRAPS = {"div": ("<div>", "</div>"), "section": ("<section>", "</section>"), "cell": ("<table><tr><td>", "</td></tr></table>")}
NEWS = (
    "<html><body><ul class=menu><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><div><h1>Storm closes the harbour road</h1>"
    "<p>The road along the harbour was closed on Monday after waves broke over the wall, and the council asked drivers to use the bridge.</p>"
    "<table><tr><th>Day</th><th>Height</th></tr><tr><td>Monday</td><td>4.2 m</td></tr></table>"
    "<p>Workers expect to open it again on Thursday, when the wind should have turned, a spokesman said.</p></div></body></html>"
)


@pytest.fixture(scope="module")
def pages(spark, tiny):
    return spark.read.parquet(f"{tiny}/pages.parquet")


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_nameless_content(spark, pages, model):
    own = [r.html for r in pages.collect()]
    rows = [(f"{name} {k}", open_, close) for name, (open_, close) in WRAPS.items() for k in range(len(own))]
    df = spark.createDataFrame([(key, "", own[int(key.split()[1])].replace("<article>", o).replace("</article>", c)) for key, o, c in rows] + [("news 0", "", NEWS)], "page_id string, url string, html string")
    got = {r.id: r.text for r in html_text.extract(df, model).collect()}
    for name in WRAPS:
        assert sum(got[f"{name} {k}"] == wanted(p) for k, p in enumerate(own)) >= 0.96 * len(own) and all(got[f"{name} {k}"] for k in range(len(own)))
    assert got["news 0"].startswith("Storm closes") and got["news 0"].endswith("spokesman said.") and "4.2 m" in got["news 0"] and "Home" not in got["news 0"]


def test_long_pages_train_the_model(pages):
    long = pages.withColumn("html", F.regexp_replace("html", "<body>", f"<body><!--{'x' * 200_000}-->"))
    model = html_text.train(long)
    assert all(r.text == wanted(r.html) for r in html_text.extract(long, model).join(long.select(F.col("page_id").alias("id"), "html"), "id").collect())


@pytest.mark.parametrize("deep", [10, 300, 5000])
def test_items_close_however_deep(deep):
    page = Page("<ul><li>a" + "<b class=x>" * deep + "b<li>c</ul><table><tr><td>" + "<i class=y>" * deep + "<td>d</table><div><p>" + "<span class=z>" * deep + "<p>e</div>")
    at = {t: page.depth[k] for k, t in page.pieces if t.strip()}
    assert at["c"] == 2 and at["d"] == 3 and at["e"] == 2 and page.tag[-1] == "p"


def test_an_inner_list_holds_the_outer_item_open():
    page = Page("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>")
    assert [(page.tag[k], page.depth[k], t) for k, t in page.pieces if t.strip()] == [("li", 2, "a"), ("li", 4, "b"), ("li", 4, "c"), ("li", 2, "d"), ("li", 2, "e")]


def test_names_that_are_anagrams_differ():
    x = [Page(f'<div class="{n}">a</div>').features()[1] for n in ("sidebar", "braside")]
    assert re.sub(r"\s", "", str(x[0])) != re.sub(r"\s", "", str(x[1]))
