import random

import numpy as np
import pytest
import sentencepiece

from jobreview.llm import pieces as P
from jobreview.llm.sentencepieces import MODEL_PATH, decode_table, encode_table

TEXTS = ["The cat  sat\n on the mat. ", "", " ", "né à l'été 😀 ▁x", "a" * 900 + " b", "Ünïcödé " * 50, "x"]


@pytest.fixture(scope="module")
def model():
    return P.PieceModel.load(MODEL_PATH)


def split(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_without_dropout_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    texts = [t for t in TEXTS if "▁" not in t]
    ids, counts = P.encode_texts(model, texts, list(range(len(texts))))
    assert split(ids, counts) == [library.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip(model, dropout):
    ids, counts = P.encode_texts(model, TEXTS, list(range(len(TEXTS))), dropout, seed=3)
    assert [b.decode() for b in P.decode_ids(model, ids, counts)] == TEXTS


def test_step_by_step_equals_the_heap(model, monkeypatch):
    args = (model, TEXTS * 3, list(range(len(TEXTS) * 3)), 0.2, 5, 8)
    ids, counts = P.encode_texts(*args)
    cached = P.encode_texts(*args, P.SegmentCache(3))
    monkeypatch.setattr(P, "LONG_WORD", 0)
    again, again_counts = P.encode_texts(*args)
    assert ids.tolist() == again.tolist() == cached[0].tolist()
    assert counts.tolist() == again_counts.tolist() == cached[1].tolist()


def test_blocks_of_words_equal_the_heap(model, monkeypatch):
    rng = random.Random(4)
    sizes = rng.choices([1, 2, 5, 9, 30, 120], k=300)
    words = ["".join(rng.choices("aeinrsté世😀_the", k=size)) for size in sizes]
    texts = [" ".join(words[a : a + 50]) for a in range(0, 300, 50)]
    for dropout in (0.0, 0.1, 0.5):
        made = []
        for long_word, block in ((512, 1 << 16), (512, 200), (0, 1 << 16)):
            monkeypatch.setattr(P, "LONG_WORD", long_word)
            monkeypatch.setattr(P, "BLOCK_SYMBOLS", block)
            made.append(split(*P.encode_texts(model, texts, list(range(6)), dropout, 7)))
        assert made[0] == made[1] == made[2]


def test_a_merge_looks_up_two_pairs(model, monkeypatch):
    """The work follows characters and merges, not all symbols left in each round."""
    looked, slots = [], P.PieceModel.slots
    monkeypatch.setattr(P.PieceModel, "slots", lambda *args: looked.append(len(args[1])) or slots(*args))
    text = " ".join(["internationalisation", "considerations", "the", "segmented"] * 500)
    ids, _ = P.encode_texts(model, [text], [1], 0.1)
    chars, words = len(text) + 1, 2000
    assert len(ids) < chars / 2
    assert sum(looked) <= chars + words + 2 * (chars - len(ids))


def test_seed_and_document_vary_the_pieces(model):
    text = "internationalisation of tokenisers"
    made = {tuple(P.encode_texts(model, [text], [doc], 0.3, seed)[0]) for doc in range(8) for seed in range(4)}
    assert len(made) > 5


def test_each_occurrence_is_drawn_on_its_own(model):
    """A word of one candidate is split where that is skipped: one time in ten."""
    for seed in range(4):
        for docs, words in ((1, 8000), (8000, 1)):
            ids, _ = P.encode_texts(model, [" ".join(["a"] * words)] * docs, list(range(docs)), 0.1, seed, cache=P.SegmentCache())
            assert 0.085 < len(ids) / 8000 - 1 < 0.115


def test_long_texts_are_cut_at_words(model, monkeypatch):
    text = "one  two three " * 40
    whole, _ = P.encode_texts(model, [text], [1])
    monkeypatch.setattr(P, "SEGMENT_CHARS", 50)
    cut, _ = P.encode_texts(model, [text], [1])
    assert whole.tolist() == cut.tolist()


def test_table(spark, frame):
    docs = frame([*TEXTS, None, None], [*range(len(TEXTS)), None, None])
    out = encode_table(docs, keep=docs.columns)
    assert out.columns == [*docs.columns, "piece_ids", "n_pieces_", "n_bytes", "lossless"]
    rows = out.collect()
    assert all(r["lossless"] for r in rows)
    assert [r["piece_ids"] is None for r in rows] == [r["text"] is None for r in rows]
    back = decode_table(out.select("doc_id", "piece_ids", "text"), text_col="decoded")
    assert back.filter("NOT text <=> decoded").count() == 0
    assert encode_table(docs.limit(0)).count() == 0
