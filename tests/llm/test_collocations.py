"""Collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jobreview.llm import collocations as C


def brute(rows, min_count, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= min_count}
        scored = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            score, _, cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, (counts[p[:k]], counts[p[k:]])) for k in range(1, len(p)))
            longer = (
                b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if not any(100 * b >= 80 * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), *cut))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    words = [*"abcdefgh", "É", "x-y", "New", "York", " z"]
    fixed = ["New York Stock Exchange", "a b c d", "new york", "a a a a a a"]
    rows = []
    for i in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(6)]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", ". ", "\n", "\t", "! ", "\x0b"]) for p in parts)))
    return rows + [("en", None), ("en", ""), (None, "..."), rows[0], rows[0]]


@pytest.mark.parametrize(("table_bytes", "chunk"), [(C.MAX_TABLE_BYTES, C.CHUNK), (C.MAX_TABLE_BYTES, 7), (0, 7)])
def test_equals_plain_count(spark, monkeypatch, table_bytes, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string")
    got = C.collocations(docs, min_count=8, top=40, max_table_bytes=table_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 8, 40)


def test_tables_in_slices_shuffle_no_places(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("a row for each place")

    monkeypatch.setattr(C, "_joined", joined)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = C.collocations(docs, min_count=8, top=40, max_table_bytes=1000)
    assert {tuple(r) for r in got.collect()} == brute(rows, 8, 40)
    assert C._slices(1000, 1000) == 1 and C._slices(1001, 1000) == 5 and C._slices(16_000, 1000) == 64
    assert C._slices(16_001, 1000) == C._slices(1, 0) == 0


class Table:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("held", [1, 64, C.HELD])
def test_slices_give_the_ids_of_one_table(monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    rows = [(lang or "und", text or "") for lang, text in corpus(7)]
    texts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 50], strict=True)], names=["lang", "text"]) for i in range(0, len(rows), 50)]
    known = {"en": [b"a", b"new", b"york", b"x-y"], "de": [b"a", b"b", b"stock"], "und": [b"z"]}
    ids = {lang: {w: len(lang) * 10 + i for i, w in enumerate(ws)} for lang, ws in known.items()}
    slices = [Table({lang: {w: i for w, i in own.items() if i % 3 == k} for lang, own in ids.items()}) for k in range(3)]

    def flat(batches):
        return [tuple(r.values()) for b in batches for r in b.select(["own", "syms"]).to_pylist()]

    whole = list(C._encode(iter(texts), [Table(ids)]))
    assert flat(C._encode(iter(texts), slices)) == flat(whole)
    keys = np.unique(np.concatenate([C._pairs(b) for b in whole]))[1::2]
    named = np.arange(len(keys), dtype=np.int32)
    own = C._slice_of(keys >> 32, keys & 0xFFFFFFFF, 4)
    parts = [Table((keys[own == k], named[own == k])) for k in range(4)]
    assert flat(C._rename(iter(whole), parts)) == flat(C._rename(iter(whole), [Table((keys, named))])) != []


def test_no_rows_and_no_phrases(spark):
    docs = spark.createDataFrame([("en", "a b. c d")], "lang string, text string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(docs.limit(0)).count() == 0


def test_tiles_count_exactly():
    rng = np.random.default_rng(1)
    x, y = (np.minimum(rng.geometric(0.01, 200_000), 5000) - 1 for _ in range(2))
    keys = (x.astype(np.int64) << 32) | y
    weights = rng.integers(1, 9, len(keys))
    for counts in (None, weights):
        made = dict(zip(*map(np.ndarray.tolist, C.tile_counts(keys, counts)), strict=True))
        expected = Counter()
        for key, w in zip(keys.tolist(), (np.ones(len(keys), int) if counts is None else counts).tolist(), strict=True):
            expected[key] += w
        assert made == expected
    assert [len(a) for a in C.tile_counts(np.zeros(0, np.int64))] == [0, 0]


def test_a_long_text_in_pieces():
    data = b"New york. " * 1_000_000
    assert sum(1 for words in C.pieces(data) if words == [b"new", b"york"]) == 1_000_000
