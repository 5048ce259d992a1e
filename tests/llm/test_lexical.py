"""Ranked lexical search against a plain scorer."""

import math
import random
import re
from collections import Counter

import pytest

from jobreview.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    docs = sorted({(i, t) for i, t in docs if i is not None}, key=lambda d: d[0])
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in {x for x in items if x[0] is not None}:
        asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * c.total() * n // total
            score = sum(
                mult * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, mult in wanted.items() if t in c
            )
            if score:
                scored.append((-score, i))
        out |= {(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    made = [" ".join(rng.choices(words, weights, k=rng.choice((1, 5, 40, 90)))) for _ in range(n)]
    items = [(i, " ".join(rng.choices(words, weights, k=15)) + f" {made[i * 7 % n]}") for i in range(12)]
    return [(i, t) for i, t in enumerate(made)], items


@pytest.mark.parametrize("whole_vocabulary", [True, False])
def test_equals_plain_scorer(spark, monkeypatch, whole_vocabulary):
    monkeypatch.setattr(X, "BLOCK_DOCS", 64)
    monkeypatch.setattr(X, "BUNDLE_ITEMS", 5)
    if not whole_vocabulary:
        monkeypatch.setattr(X, "MAX_VOCABULARY_BYTES", 0)
    docs, items = corpus(400)
    # copies that tie, null and empty texts, repeated rows, odd characters
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "--!"), (None, "w1 w2"), docs[3], (2003, "W1_w2 Éé w1\tw2\x00w3")]
    items += [(50, "w1_W2 Éé"), (51, ""), (52, None), (None, "w1"), items[0], (53, "nothing of it")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, score long")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = X.search(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_ties_go_to_smaller_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50, 0, -1)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r["doc_id"] for r in X.search(docs, items).orderBy("rank").collect()] == list(range(1, 21))
    assert X.search(docs.limit(0), items).count() == 0
    assert X.search(docs, items.limit(0)).count() == 0


def test_very_long_text():
    data = b"Ab c_d " * 1_000_000
    assert X.term_counts(data) == {b"ab": 1_000_000, b"c": 1_000_000, b"d": 1_000_000}
