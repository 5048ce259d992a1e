"""The main text of web pages: a recurrent network labels every block.

A page is read into blocks (``html_blocks``). Each block is a vector: hashed
words of its tag path, hashed words of its text, and a few measures. A
bidirectional LSTM (``block_lstm``) reads the blocks of a whole page in both
directions and says of each whether it belongs to the article.

No table says which blocks do, so the network learns from pages whose labels are
known by construction. A bounded sample of pages (``MAX_TRAIN_PAGES`` distinct
ones of at most ``MAX_TRAIN_CHARS`` characters, by hash order) is labelled where
the markup says it plainly; then their blocks are laid out anew, in many kinds of
markup: articles in other elements or in none that tells, menus, notices,
adverts, forms and readers' comments before, inside and after them. The network
sees the tag words of a page only in part while it learns, so that it also goes
by what stands around a block.

Every page is read whole, and every block judged, however many there are: a long
page goes through the network in steps, forward and backward.

Defined results: null and empty pages, and pages without such blocks, have the
empty text; rows are judged one by one, so repeated rows give equal results;
columns that clash get an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobreview.llm.block_lstm import BlockLabeller
from jobreview.llm.common import fresh
from jobreview.llm.html_blocks import Block, blocks

MAX_TRAIN_PAGES = 200
MAX_TRAIN_CHARS = 1 << 16
LAYOUTS = 4
EPOCHS = 6
HIDDEN = 24
PATH_SLOTS, LEAF_SLOTS, WORD_SLOTS, MEASURES = 160, 48, 64, 8
INPUTS = PATH_SLOTS + LEAF_SLOTS + WORD_SLOTS + MEASURES
THRESHOLD = 0.5
# Blocks that go through the network at once, and pages read at once.
STEP = 4096
READ = 128


# Vectors --------------------------------------------------------------------


class _Slots(dict):
    """Word -> slot; forgets all words before it grows too large."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode()) % self.n
        return slot


class Vectors:
    """Inputs of the network for blocks of one page."""

    def __init__(self):
        self.words = _Slots(WORD_SLOTS)
        self.path_words = _Slots(PATH_SLOTS)
        self.leaf_words = _Slots(LEAF_SLOTS)
        self.paths: dict[tuple, np.ndarray] = {}

    def _path(self, path: tuple) -> np.ndarray:
        made = self.paths.get(path)
        if made is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            made = np.zeros(PATH_SLOTS + LEAF_SLOTS, np.float32)
            for element in path:
                for i, word in enumerate(element):
                    made[self.path_words["." + word if i else word]] = 1
            for element in path[-2:]:
                made[PATH_SLOTS + self.leaf_words[element[0]]] = 1
            self.paths[path] = made
        return made

    def of(self, page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
        end = len(page) if end is None else end
        x = np.zeros((end - start, INPUTS), np.float32)
        at = PATH_SLOTS + LEAF_SLOTS
        for i in range(start, end):
            block, row = page[i], x[i - start]
            row[:at] = self._path(block.path)
            words = block.text.split(" ")
            counts = np.bincount(list(map(self.words.__getitem__, words)), minlength=WORD_SLOTS)
            row[at : at + WORD_SLOTS] = np.sqrt(counts / len(words))
            size = len(block.text)
            row[at + WORD_SLOTS :] = (
                np.log1p(size) / 5,
                np.log1p(len(words)) / 4,
                block.linked,
                block.text[-1] in ".!?…",
                block.text.count(". ") > 0,
                len(block.path) / 10,
                i / len(page),
                min(1, 10 / len(page)),
            )
        return x


# Training pages -------------------------------------------------------------
#
# Fixed values, all of this section: words of markup that say what a block is,
# and phrases that stand in such blocks.

NOT_MAIN = frozenset(
    "nav footer aside form menu menubar sidebar ad ads advert advertisement sponsor sponsored promo banner cookie "
    "cookies consent notice alert comment comments reply replies breadcrumb breadcrumbs pagination newsletter "
    "subscribe share social related login search popup modal button label fieldset dialog navigation copyright".split()
)
MAIN = ("article", "main")

CONTENT_WRAPS = (
    "article", "main", "main article", "div.main article", "div.content", "div.post.content", "section.article", "div.entry.content",
    "div.article.body", "main div.story", "div.page div.text", "div", "section", "table tbody tr td", "div.blog.post", "article section",
    "article div.body", "div.main.content section", "article div.entry", "div.prose",
)
OUTER_WRAPS = ("html body", "html body", "html body", "html body div.wrapper", "html body div.container", "html body div.page div.row", "body", "html body div.site")
BOILERPLATE = {
    "menu": ("nav ul li a", "nav a", "div.menu ul li a", "ul.nav li a", "header nav ul li a", "div.navigation a", "ul.menubar li a", "div.breadcrumb a", "div.breadcrumbs span a", "ul.pagination li a", "div.toc ul li a", "ul li a", "header ul li a"),
    "header": ("header p", "header div", "header div.logo", "div.header", "div.header p", "div.masthead", "div.topbar span", "header h1 a", "div.site.header p", "header"),
    "footer": ("footer", "footer p", "footer div", "div.footer", "div.footer p", "div.copyright", "div.site.footer p", "footer ul li a", "div.bottom p", "footer small"),
    "sidebar": ("aside p", "aside", "aside h3", "aside ul li a", "div.sidebar p", "div.sidebar ul li a", "div.widget p", "div.related ul li a", "section.related p", "div.share a", "div.social ul li a", "aside section p", "div.side p", "div.recommended p"),
    "notice": ("div.cookie p", "div.cookie.notice", "div.notice p", "div.notice", "div.alert p", "div.alert", "div.consent p", "dialog p", "div.popup p", "div.modal p", "div.banner p", "p.notice", "div.paywall p", "section.notice p"),
    "advert": ("div.ad", "div.ad p", "div.ads p", "div.advert p", "div.advertisement", "aside.ad p", "div.sponsored p", "div.promo p", "ins.adsbygoogle", "section.sponsor p", "p.ad", "div.banner.ad", "figure.ad figcaption"),
    "form": ("form", "form p", "form label", "form button", "form fieldset legend", "div.newsletter form p", "div.subscribe p", "div.login form label", "div.search form label", "form div", "form h3", "div.form label", "div.signup p"),
    "comment": ("section.comments p", "section.comments div.comment p", "div.comments p", "div.comment p", "div.comment", "ul.comments li p", "ol.commentlist li p", "ol.comments li", "div.replies div.reply p", "section.comments h2", "div.reader.comments p", "section.comments article p", "section.comments article.comment p", "div.responses div p", "div.discussion p"),
}
PHRASES = {
    "menu": "Home|About|Contact|News|Blog|Products|Sign in|Accueil|Kontakt|Inicio|Next|Previous|Archive|Help",
    "header": "The daily journal|Welcome to our site|Your source for news|Menu|Skip to content|Willkommen|Bienvenue",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Impressum|Mentions légales|Powered by our team · Contact us",
    "sidebar": "Related articles|Most read|Follow us|Share this|You may also like|About the author|Tags|Lire aussi",
    "notice": "We use cookies to improve your experience.|Accept all cookies|This site uses cookies. Read our privacy policy.|Please enable JavaScript.|Wir verwenden Cookies.|Nous utilisons des cookies.|Subscribe to read on.",
    "advert": "Advertisement|Sponsored|Buy now and save 50%|Special offer today only!|Anzeige|Publicité|Limited time offer, order now.",
    "form": "Your email address|Sign up|Subscribe to our newsletter|Password|Search|Submit|Name|Send|Leave a reply",
    "comment": "Great article, thanks!|I do not agree with this.|Comments|3 comments|Reply|Thanks for sharing.|First!|Posted by reader",
}
PROSE = (
    "The river had been rising for three days before anyone in the valley took notice of it.",
    "Researchers found that the effect was stronger in the second group, although the sample was small.",
    "Preheat the oven, then mix flour and butter until the dough is smooth.",
    "Der Rat beschloss am Abend, den Bau der Brücke um ein Jahr zu verschieben.",
    "La ville a changé depuis que le port est fermé, disent les habitants.",
    "Los resultados muestran que la temperatura media subió durante el último decenio.",
)


def _elements(spec: str) -> tuple[tuple[str, ...], ...]:
    """``div.a.b p`` as a path."""
    return tuple(tuple(part.split(".")) for part in spec.split())


def plain_label(block: Block) -> bool:
    """What the markup says plainly: inside an article or main element, and in
    nothing that is named for something else."""
    words = {word for element in block.path for word in element}
    return any(name in words for name in MAIN) and not words & NOT_MAIN


def _part(rng: random.Random, text: str) -> str:
    """Some words of a text, as a sentence may be."""
    words = text.split(" ")
    start = rng.randrange(len(words))
    return " ".join(words[start : start + rng.randint(1, 25)])


def _other(rng: random.Random, prose: list[str], inside: tuple) -> list[Block]:
    """A run of blocks of one kind that is not main text."""
    kind = rng.choice(tuple(BOILERPLATE))
    spec = rng.choice(BOILERPLATE[kind])
    above = _elements(spec)
    phrases = PHRASES[kind].split("|")
    found = []
    for _ in range(rng.randint(2, 8) if kind == "menu" else rng.choice((1, 1, 1, 2, 3, 5))):
        own = rng.random() < (0.8 if kind in ("comment", "advert", "sidebar", "notice", "footer", "header") else 0.5)
        text = _part(rng, rng.choice(prose)) if own else rng.choice(phrases)
        if kind == "menu" and own:
            text = " ".join(text.split(" ")[:2])
        found.append(Block(inside + above, text, 1.0 if spec.endswith("a") and above[-1] == ("a",) else 0.0))
    return found


def laid_out(rng: random.Random, main: list[str], prose: list[str]) -> tuple[list[Block], list[bool]]:
    """A page with the texts ``main`` as its article and other blocks around."""
    outer, wrap = _elements(rng.choice(OUTER_WRAPS)), _elements(rng.choice(CONTENT_WRAPS))
    before = [b for _ in range(rng.randint(0, 3)) for b in _other(rng, prose, outer)]
    after = [b for _ in range(rng.randint(0, 4)) for b in _other(rng, prose, outer)]
    page, labels = list(before), [False] * len(before)
    inner = wrap + ((("header",),) if rng.random() < 0.1 else ())
    for i, text in enumerate(main):
        leaf = rng.choice(("h1", "h1", "p")) if i == 0 else rng.choice(("p",) * 8 + ("h2", "h3", "li", "blockquote", "pre", "div"))
        above = {"li": _elements("ul li"), "blockquote": _elements("blockquote p"), "div": _elements("div")}.get(leaf, ((leaf,),))
        page.append(Block(outer + (inner if i == 0 else wrap) + above + ((("b",),) if rng.random() < 0.1 else ()), text, 0.0))
        labels.append(True)
        if rng.random() < 0.08:
            more = _other(rng, prose, outer + wrap)
            page += more
            labels += [False] * len(more)
    return page + after, labels + [False] * len(after)


def _tag_words_lost(rng: random.Random, x: np.ndarray) -> np.ndarray:
    """Some of the tag words of a page, and of the text words of a block, hidden."""
    x = x.copy()
    if rng.random() < 0.4:
        x[:, [i for i in range(PATH_SLOTS) if rng.random() < 0.25]] = 0
    at = PATH_SLOTS + LEAF_SLOTS
    hidden = np.array([rng.random() < 0.5 for _ in range(len(x))])
    x[hidden, at : at + WORD_SLOTS] = 0
    return x


def training_sequences(htmls: list[str], layouts: int = LAYOUTS, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inputs and labels: the given pages, and pages laid out from their blocks."""
    rng, vectors, sequences = random.Random(seed), Vectors(), []
    read = [page for page in map(blocks, htmls) if page]
    mains = [[b.text for b in page if plain_label(b)] for page in read]
    mains = [main for main in mains if main]
    prose = [text for main in mains for text in main if text.count(" ") > 4] + list(PROSE)
    for page in read:
        labels = [plain_label(b) for b in page]
        if any(labels):
            for _ in range(2):
                sequences.append((_tag_words_lost(rng, vectors.of(page)), np.array(labels, np.float32)))
    for _ in range(max(200, layouts * len(read))):
        texts = rng.choice(mains) if mains and rng.random() < 0.5 else [_part(rng, t) if rng.random() < 0.4 else t for t in rng.choices(prose, k=rng.randint(1, 12))]
        page, labels = laid_out(rng, texts[:40], prose)
        sequences.append((_tag_words_lost(rng, vectors.of(page)), np.array(labels, np.float32)))
    return sequences


def fit_labeller(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_TRAIN_PAGES, max_chars: int = MAX_TRAIN_CHARS, seed: int = 1) -> BlockLabeller:
    """The network, fit on at most ``max_pages`` distinct pages of at most
    ``max_chars`` characters: those with the least hashes."""
    html = F.col(f"`{html_col}`").cast("string")
    rows = pages.select(html.alias("html"), F.xxhash64(html).alias("h")).filter(F.length("html").between(1, max_chars))
    least = [row["h"] for row in rows.select("h").distinct().orderBy("h").limit(max_pages).collect()]
    htmls = []
    if least:
        picked = rows.filter(F.col("h").isin(least)).dropDuplicates(["h"])
        htmls = [row["html"] for row in sorted(picked.collect(), key=lambda row: row["h"])]
    model = BlockLabeller.fresh(INPUTS, HIDDEN, seed)
    model.fit(training_sequences(htmls, seed=seed), EPOCHS, seed=seed)
    return model


# Extraction -----------------------------------------------------------------


def block_scores(model: BlockLabeller, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
    """The network's score of each block of each page."""
    scores: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, page in enumerate(pages) if page), key=lambda i: len(pages[i]))
    while order:
        group = [order.pop(0)]
        if len(pages[group[0]]) > STEP:
            page = pages[group[0]]
            scores[group[0]] = model.long_scores(lambda a, b, page=page: vectors.of(page, a, b), len(page), STEP)
            continue
        while order and len(pages[order[0]]) * (len(group) + 1) <= STEP:
            group.append(order.pop(0))
        lengths = np.array([len(pages[i]) for i in group])
        x = np.zeros((len(group), lengths.max(), INPUTS), np.float32)
        for row, i in enumerate(group):
            x[row, : lengths[row]] = vectors.of(pages[i])
        for row, made in zip(group, model.scores(x, lengths), strict=True):
            scores[row] = made[: len(pages[row])]
    return scores


def main_text(page: list[Block], scores: np.ndarray) -> str:
    return "\n".join(block.text for block, score in zip(page, scores, strict=True) if score >= THRESHOLD)


def _extracted(batches: Iterator[pa.RecordBatch], model: BlockLabeller) -> Iterator[pa.RecordBatch]:
    vectors = Vectors()
    for batch in (whole.slice(i, READ) for whole in batches for i in range(0, whole.num_rows, READ)):
        pages = [blocks(html.as_py()) for html in batch.column(batch.num_columns - 1)]
        texts = [main_text(page, made) for page, made in zip(pages, block_scores(model, pages, vectors), strict=True)]
        made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "text", "n_chars"])


def _named(batches: Iterator[pa.RecordBatch], extract, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in extract(batches):
        yield batch.rename_columns(names)


def extract_main_text(pages: DataFrame, model: BlockLabeller, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns) with ``text`` and ``n_chars``, its code points."""
    kept = pages.columns if keep is None else keep
    slim = pages.select(*[F.col(f"`{c}`") for c in kept])
    text, n_chars = fresh(slim, "text"), fresh(slim, "n_chars")
    html = F.col(f"`{html_col}`").cast("string").alias(fresh(slim, "_html"))
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], html)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    shape = f"{shape}, `{text}` string, `{n_chars}` long".removeprefix(", ")
    names = [*slim.columns, text, n_chars]
    return rows.mapInArrow(lambda batches: _named(batches, lambda b: _extracted(b, model), names), shape)


def _labelled(batches: Iterator[pa.RecordBatch], model: BlockLabeller) -> Iterator[pa.RecordBatch]:
    vectors = Vectors()
    for batch in (whole.slice(i, READ) for whole in batches for i in range(0, whole.num_rows, READ)):
        pages = [blocks(html.as_py()) for html in batch.column("html")]
        rows = []
        for id_, page, made in zip(batch.column("id"), pages, block_scores(model, pages, vectors), strict=True):
            for no, (block, score) in enumerate(zip(page, made, strict=True)):
                path = "/".join(".".join(element) for element in block.path)
                rows.append((id_, no, path, block.text, float(score), bool(score >= THRESHOLD)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (batch.schema.field("id").type, pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_())
        names = ["id", "block", "path", "text", "score", "main"]
        yield pa.RecordBatch.from_arrays([pa.array([getattr(v, "as_py", lambda v=v: v)() for v in c], k) for c, k in zip(columns, kinds, strict=True)], names=names)


def label_blocks(pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every block of every page: id, block (its place), path, text, score, main."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, block int, path string, text string, score double, main boolean"
    return rows.mapInArrow(lambda batches: _labelled(batches, model), shape).withColumnRenamed("id", id_col)


# What the article holds on the given pages, by their own markup: not how the
# operator finds it.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, unnest(string_split_regex(body, '</?(h1|p|ul|li|div)[^>]*>')) AS part,
    generate_subscripts(string_split_regex(body, '</?(h1|p|ul|li|div)[^>]*>'), 1) AS no
  FROM a
), t AS (
  SELECT page_id, no, trim(regexp_replace(regexp_replace(regexp_replace(part, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '[\s]+', ' ', 'g')) AS part
  FROM b
), d AS (
  SELECT page_id, no, regexp_replace(replace(replace(replace(regexp_replace(part, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;?', '&', 'g') AS part
  FROM t WHERE part <> ''
), x AS (SELECT page_id, string_agg(part, chr(10) ORDER BY no) AS text FROM d GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM a LEFT JOIN x USING (page_id)
"""
