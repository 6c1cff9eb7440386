"""Pages of other layouts than the sampled ones, and pages built to be slow."""

import html
import re
import time

import pytest

from ferrule.llm import html_text
from ferrule.llm.html_text import Page


@pytest.fixture(scope="module")
def model(spark, tiny):
    return html_text.train(spark.read.parquet(f"{tiny}/pages.parquet"))


def wanted(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


LAYOUTS = {
    "no head end": lambda h: h.replace("</head>", ""),
    "named div": lambda h: h.replace("<article>", '<div class="post-content">').replace("</article>", "</div>"),
    "inline advert": lambda h: re.sub(r"(<article>.*?<p>[^<]*)", r'\1<span class="ad">buy this thing now please</span>', h, count=1, flags=re.S),
    "named word": lambda h: re.sub(r"(<article>.*?<p>)(\w+)", r'\1<span class="hl">\2</span>', h, count=1, flags=re.S),
    "block advert": lambda h: re.sub(r"(<article>.*?</p>)", r'\1<div class="advert">buy this thing now please</div>', h, count=1, flags=re.S),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_texts_of_other_layouts(spark, tiny, model, name):
    pages = [r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()]
    for page in pages:
        own = Page(LAYOUTS[name](page))
        assert own.decode(model.predict(own.features())) == wanted(page)


@pytest.mark.parametrize("page", ["<div>", "<ul><li><div>", "<div></p></b></span>", '<span class="x">', "<p><li>"])
def test_deep_pages_take_linear_time(page):
    began = time.time()
    assert len(Page(page * 50_000 + "deep").tag) > 50_000 or page == "<p><li>"
    assert time.time() - began < 20


def test_inline_nodes_close_where_they_should():
    page = Page('<p>a<span class="ad">b<span>c</span>d</span>e<b>f</b></p>g')
    assert [(page.tag[k], t) for k, t in page.pieces if t] == [("p", "a"), ("span", "b"), ("span", "c"), ("span", "d"), ("p", "e"), ("p", "f"), ("#", "g")]


def test_media_fallbacks_are_text():
    assert "".join(t for _, t in Page("<p>x<math>1+2</math><video>seen</video></p>").pieces) == "x1+2seen"
