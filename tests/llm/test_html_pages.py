"""Pages as they come: quotes in every place, odd comments, no wrapper, cut tags."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seasonframe.llm import html_extract

P = "This is the article of the page. It has two sentences, and then another one that goes on for a while."


@pytest.fixture(scope="module")
def texts_of(spark):
    model = html_extract.train_extractor()

    def run(pages):
        df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(2)
        return [r["text"] for r in html_extract.extract_main_text(df, model).orderBy("page_id").collect()]

    return run


def test_odd_markup(texts_of):
    cases = {
        f"<article><p>{P}</p><img alt=it's src=x><p>{P}</p></article>": f"{P} {P}",
        f'<article><p class="a>{P}</p><p>{P}</p></article>': f"{P} {P}",
        f"<article><p data-x=a\"b'c>{P}</p><p '>{P}</p><p \"x\">{P}</p></article>": f"{P} {P} {P}",
        f"<article><p title='x > y' class = \"b > c\">{P}</p></article>": P,
        f"<article><!--><p>{P}</p><!---><p>{P}</p><!-- x --!><p>{P}</p><!-- a -- b > c --></article>": f"{P} {P} {P}",
        f"<article><p>{P}</p><p class='x": P,
        f"<article><p>{P}</p><a href=": P,
        f"<article><p>{P}</p><!-- never closed <p>{P}</p>": P,
        f"<p>{P}</p>": P,
        P: P,
        f"{P}<br>{P}": f"{P} {P}",
        f"<p>{P}</p>\n<p>{P}</p>": f"{P} {P}",
        f"<div>{P}</div>": P,
        f"<!doctype html><title>t</title><p>{P}": P,
        f"<table><tr><td>{P}</td><td>{P}</td></tr></table>": f"{P} {P}",
        f"<nav><a href=x>a</a> <a href=y>b</a></nav><p>{P}</p><p>{P}</p><footer>&copy; me</footer>": f"{P} {P}",
        f"<p>{P} 1 < 2, a<b and </> 3 > 2.</p>": None,
        "": "",
        "<nav><a href='x'>a</a></nav>": None,
    }
    for (page, want), got in zip(cases.items(), texts_of(list(cases)), strict=True):
        assert want is None or got == want, page


def test_no_tag_in_any_result(texts_of):
    """Made pages with lone quotes, comments and signs put into their tags: no tag is left in a result, no article is lost."""
    rng = random.Random(6)
    maker = html_extract._Maker(11)
    pages = []
    for _ in range(150):
        page = maker.page().replace("\x01", "")
        spots = [m.end(1) for m in re.finditer(r"(<(?:p|div|h2|li|td|blockquote))(?=[ >])", page)]
        for at in sorted(rng.sample(spots, min(4, len(spots))), reverse=True):
            page = page[:at] + rng.choice([" alt=it's", " '", ' "', " x=a'b\"c", " title='a > b'", ' data="<p>"', " =", " a==b", " /"]) + page[at:]
        pages.append(page.replace("</p>", rng.choice(["</p>", "</p><!-->", "</p><!-- a > b --!>", "</ p>", "</p >"]), 2))
    texts = texts_of(pages)
    assert not [t for t in texts if re.search(r"</?[a-z]+[ >]", t)]
    assert sum(bool(t) for t in texts) >= 145


def test_repeated_and_null_pages(spark):
    model = html_extract.train_extractor()
    df = spark.createDataFrame([(1, None), (2, f"<p>{P}</p>"), (2, f"<p>{P}</p>"), (None, P)], "page_id long, html string").withColumn("text", F.lit("old"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (2, P, len(P)), (2, P, len(P)), (None, P, len(P))], key=str)
