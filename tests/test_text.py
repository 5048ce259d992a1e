"""Text columns against Python's own results."""

import re

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from jobreview.functions import text as X
from jobreview.functions.templates import fill

STRINGS = [
    "",
    "one",
    "a\nb",
    "a\r\nb\rc",
    "a\n\nb\n",
    "a\r\n",
    "\n",
    "\n\n",
    "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i",
    "ends ",
    "keeps space \n",
    "x <b\nc> y",
    "1 < 2 and <i>3</i> > 2",
    "<a\r>z< >",
    "tab\tand nbsp\xa0",
]


def column_values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [row[0] for row in rows.orderBy("i").select(column.alias("v")).collect()]


def test_flatten_lines(spark):
    actual = column_values(spark, STRINGS, X.flatten_lines(F.col("t")))
    assert actual == [" ".join(s.splitlines()) for s in STRINGS]


def test_strip_tags(spark):
    actual = column_values(spark, STRINGS, X.strip_tags(F.col("t")))
    assert actual == [re.sub("<.*?>", "", s) for s in STRINGS]


FLAT_HTML = {
    "<ul><li>one</li><li> two </li></ul>": "- one\n- two",
    "<li>Use <b> cache </b> now</li>": "- Usecachenow",
    "<LI class='x'>up</LI >": "- up",
    "<link rel='x'><li>\xa0a b\n</li>": "- a b",
    "no list": "",
    "<li></li>": "- ",
}
OTHER_HTML = {
    "<ul><li>outer<ul><li>inner</li></ul></li></ul>": "- outerinner\n- inner",
    "<li>a &amp; b &lt;</li>": "- a & b <",
    "<li>a<li>b": "- ab\n- b",
    "<li>x<!-- hidden -->y</li>": "- xy",
    "<li>x<script>var a</script></li>": "- x",
    "<li>a<br> b</li><p>after</p>": "- ab",
}


def test_flat_bullets(spark):
    html = list(FLAT_HTML)
    assert column_values(spark, html, X.list_bullets(F.col("t"))) == list(FLAT_HTML.values())
    assert all(column_values(spark, html, X.is_flat_list(F.col("t"))))


def test_any_html_bullets(spark):
    html = {**FLAT_HTML, **OTHER_HTML}
    actual = column_values(spark, list(html), X.list_bullets(F.col("t"), any_html=True))
    assert actual == list(html.values())


def test_parser_and_patterns_agree():
    for html, bullets in {**FLAT_HTML, **OTHER_HTML}.items():
        assert X._bullets(html) == bullets


@pytest.mark.parametrize(
    "text,expected",
    [("<li>a</li>", "- a"), ("<LI>a</LI>", "<LI>a</LI>"), ("plain", "plain")],
)
def test_bullets_only_for_plain_items(spark, text, expected):
    assert column_values(spark, [text], X.bullets_if_list(F.col("t"))) == [expected]


def test_fill_shows_null_as_none(spark):
    filled = fill("{a}-{b}!", a=F.col("t"), b="x{y}")
    assert column_values(spark, ["1", None], filled) == ["1-x{y}!", "None-x{y}!"]


def test_elements_without_item_text_and_cdata(spark):
    html = {
        "<ul><li>a<![CDATA[ x ]]>b</li></ul>": "- axb",
        "<li><ruby>k<rt>no</rt><rp>(</rp></ruby><template>z</template> y&amp;</li>": "- ky&",
        "<li>o<ul><li>i</li></ul></li>": "- oi\n- i",
    }
    assert column_values(spark, list(html), X.list_bullets(F.col("t"))) == list(html.values())


HARD_LISTS = [
    "<ul><li>a &amp; b<ul><li>c</li><li> d <b>e</b></li></ul></li><li>f</li></ul>",
    "<li>x<li>y</li>z</li>tail<li>",
    "<li>&lt;b&gt; &#65;&#x42;&#x1F600; &notit; &eacute &unknown; &#0; &#xD800; & &</li>",
    "<ol><li>a<br>b<img src='x>y'/>c</li></ol></ol></li><p>out</p><li/>d",
    "<li>a<script>var x = '<li>no</li>';</script>b<!-- <li> -->c<style>li{}</style></li>",
    "<LI CLASS=\"x\">Up\n per</Li ><li>  t  </li>",
    "<div><li>one<template><p>no</p></template>two</div>three</li><li>a<ruby>b<rt>no</rt><rp>(</rp></ruby></li>",
    "no list",
    "",
]


def test_walk_reads_lists_as_the_parser_does(spark):
    df = spark.createDataFrame(list(enumerate([*HARD_LISTS, None])), "i int, html string")
    rows = df.select("html", X.walked_bullets(F.col("html")).alias("walked")).collect()
    for row in rows:
        assert row.walked == (None if row.html is None else X._bullets(row.html)), row.html
    assert "Python" not in plan_of(df.select(X.walked_bullets(F.col("html"))))


def test_markup_outside_the_items_keeps_a_list_flat(spark):
    flat = "<!DOCTYPE html><script>a<b</script><!-- x &amp; --><p>&amp;</p><ul><li>one <b>two</b><li></ul>"
    cases = {
        flat.replace("<li></ul>", "</li></ul>"): True,
        "<li>a</li><!-- cut <li>b</li>": False,
        "<li>a &amp; b</li>": False,
        "<li>a<li>b</li>": False,
        "<template><li>a</li></template>": False,
        "&amp;<style>li &gt; {}</style><li>a<!-- c --> b</li>": True,
    }
    df = spark.createDataFrame([(html,) for html in cases], "html string")
    rows = df.select("html", X.is_flat_list(F.col("html")).alias("flat"), X.list_bullets(F.col("html")).alias("b")).collect()
    assert {row.html: row.flat for row in rows} == cases
    assert all(row.b == X._bullets(row.html) for row in rows)
