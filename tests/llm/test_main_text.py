"""Main text of web pages: the block reader, the network, whole pages."""

import numpy as np
import pytest

from jobreview.llm import main_text as M
from jobreview.llm.block_lstm import BlockLabeller, padded
from jobreview.llm.common import table
from jobreview.llm.html_blocks import blocks


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks_of_odd_markup():
    assert texts(None) == texts("") == texts("<p> </p><script>x</p>") == []
    assert texts("<p>a<br>b <b>c</b>d&amp;&#x41;&eacute;&am</p>tail") == ["a b cd&Aé&am", "tail"]
    assert texts('<p>one<p>two<ul><li>x<li>y<ul><li>z</ul></ul><div title="a>b">c</div') == ["one", "two", "x", "y", "z", "c"]
    assert texts("<style>p{}</style><!-- <p>no</p> --><p>a &lt;b&gt; < c</p><textarea>t</textarea><!-- cut <p>x") == ["a <b> < c"]
    assert texts("<head><title>t</title></head><template><p>x</p></template><table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<p>&am<b>p;</b></p></nav></p>") == ["&amp;"]
    assert blocks('<div class="Side-Bar x" id=\'top\'><a href=#>l</a></div>')[0].path == (("div", "side", "bar", "x", "top"), ("a",))
    assert [b.path for b in blocks("<article><p><b>a<p>b</article><p>c")] == [(("article",), ("p",), ("b",)), (("article",), ("p",)), (("p",),)]


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model = BlockLabeller.fresh(5, 3, 1)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    sequences = [(rng.normal(size=(n, 5)), rng.integers(0, 2, n)) for n in (4, 2, 1)]
    x, y, lengths = padded(sequences)
    x = x.astype(np.float64)
    _, grads = model.gradients(x, y, lengths)
    for name, part in model.parts.items():
        for at in list(np.ndindex(part.shape))[:: max(1, part.size // 12)]:
            old, losses = part[at], []
            for step in (1e-5, -1e-5):
                part[at] = old + step
                losses.append(model.gradients(x, y, lengths)[0])
            part[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-6, name


def test_long_pages_score_as_short_ones_do():
    rng = np.random.default_rng(0)
    model = BlockLabeller.fresh(6, 4, 1)
    x = rng.normal(size=(50, 6)).astype(np.float32)
    whole = model.scores(x[None], np.array([50]))[0]
    assert np.allclose(whole, model.long_scores(lambda a, b: x[a:b], 50, 7), atol=1e-6)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return M.fit_labeller(table(spark, sf_dir, "pages"))


STORY = [
    "A storm in the north",
    "The river had been rising for three days before anyone in the valley took any notice of it, he said.",
    "Nobody was hurt. The road is closed until the water falls, and the school stays shut on Monday.",
    "Short one.",
]
AROUND = (
    '<nav><a href="/">Home</a><a href="/n">News</a></nav>',
    '<div class="cookie-notice"><p>We use cookies to improve your experience.</p></div>',
    '<form action="/s"><label>Your email address</label><button>Subscribe</button></form>',
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>I saw the river myself, it was very high indeed.</p></div></section>',
    '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/x">Ten recipes</a></li></ul></aside>',
    "<footer><p>© 2024 All rights reserved.</p></footer>",
)
SHAPES = ("<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', '<main><div class="story">%s</div></main>')


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("inside", [False, True])
def test_articles_in_other_markup(spark, model, shape, inside):
    story = f"<h1>{STORY[0]}</h1>" + "".join(f"<p>{t}</p>" for t in STORY[1:])
    nav, cookie, form, comments, aside, footer = AROUND
    if inside:
        html = nav + cookie + shape % (story + form) + comments + aside + footer
    else:
        html = nav + cookie + shape % story + form + comments + aside + footer
    html = f"<!DOCTYPE html><html><head><title>t</title><script>var a;</script></head><body>{html}</body></html>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert M.extract_main_text(pages, model).first()["text"].split("\n") == STORY


def test_rows_and_columns(spark, model):
    html = "<article><p>Some words that are the whole of it, and more.</p></article>"
    rows = [(1, html, "x", 9), (1, html, "x", 9), (2, None, "y", None), (None, "", None, 1), (3, "<nav><a>Home</a></nav>", "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    out = M.extract_main_text(pages, model)
    assert out.columns == ["page_id", "html", "text", "n_chars", "text_", "n_chars_"]
    got = sorted((r["page_id"] or 0, r["text_"], r["n_chars_"]) for r in out.collect())
    words = "Some words that are the whole of it, and more."
    assert got == [(0, "", 0), (1, words, len(words)), (1, words, len(words)), (2, "", 0), (3, "", 0)]
    assert M.extract_main_text(pages.limit(0), model).count() == 0
    labelled = M.label_blocks(pages, model).filter("page_id = 1").collect()
    assert [(r["block"], r["path"], r["main"]) for r in labelled] == [(0, "article/p", True)] * 2


def test_a_very_long_page(spark, model):
    words = "Word after word stands in this long text, and no end is near."
    html = "<nav><a>Home</a></nav><article>" + f"<p>{words}</p>" * 20_000 + "</article><footer>© all</footer>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert M.extract_main_text(pages, model, keep=["page_id"]).first()["text"] == "\n".join([words] * 20_000)


def test_without_pages_to_learn_from(spark):
    pages = spark.createDataFrame([(1, None)], "page_id long, html string")
    untaught = M.fit_labeller(pages)
    assert [r["text"] for r in M.extract_main_text(pages, untaught).collect()] == [""]
