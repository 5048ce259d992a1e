import hashlib
from collections import Counter

import numpy as np
import pytest

from jobreview.llm import repeats as R
from jobreview.llm.suffix_array import repeated_windows, suffix_order


def brute(texts):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in blobs for i in range(len(b) - 199))
    out = []
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50, 500])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_order(n, letters):
    s = np.random.default_rng(n).integers(1, letters + 1, n)
    assert suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_repeated_windows():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 3, 260).astype(np.uint8)
    block = np.concatenate([rng.integers(0, 250, 300).astype(np.uint8), common, rng.integers(0, 250, 301).astype(np.uint8), common])
    starts = np.arange(len(block) - 199)
    seen = Counter(block[i : i + 200].tobytes() for i in starts)
    assert repeated_windows(block, starts, 200).tolist() == [seen[block[i : i + 200].tobytes()] > 1 for i in starts]


@pytest.mark.parametrize("max_pieces", [R.MAX_PIECES, 1])
def test_whole_table_equals_brute_force(spark, frame, sf_dir, monkeypatch, max_pieces):
    monkeypatch.setattr(R, "MAX_PIECES", max_pieces)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.collect()] + [None, "", "a" * 900, "é" * 150, "é" * 150]
    rows = R.remove_repeats(frame(texts).repartition(3)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == brute(texts)


def test_parts_of_long_texts(frame, monkeypatch):
    monkeypatch.setattr(R, "PART", 1000)
    rng = np.random.default_rng(3)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))
    texts = [text + "end", text[1500:3500] + text, None]
    rows = R.remove_repeats(frame(texts, [1, 1, None])).collect()
    assert sorted(tuple(r)[1:5] for r in rows) == sorted(brute(texts))


def test_empty_table(frame):
    assert R.remove_repeats(frame([])).count() == 0


def spans_of(text, covered):
    kept = bytes(b for b, c in zip(text.encode(), covered, strict=True) if not c)
    spans = sum(c and (not i or not covered[i - 1]) for i, c in enumerate(covered))
    return len(covered), sum(covered), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("period", ["a", "abcdefg", "".join(chr(97 + i * i % 26) for i in range(60))])
def test_texts_that_repeat_themselves(frame, period):
    size = 5_000_000
    text = "start " + (period * (size // len(period))) + "#end"
    row = R.remove_repeats(frame([text])).collect()[0]
    # all windows that lie in the run repeat; its ends are covered by them
    covered = [6 <= i < len(text) - 4 for i in range(len(text))]
    assert tuple(row)[1:5] == spans_of(text, covered)


def test_few_rows_for_a_short_period():
    import pyarrow as pa

    data = b"x" * 300 + b"abcdefg" * 100_000
    batch = pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary()), "text_a": [1], "text_b": [2]})
    for kind in ("keys", "bytes", "places"):
        rows = pa.Table.from_batches(list(R._emit([batch], kind)))
        assert rows.num_rows < 1_000
        counts = rows.column("times" if kind == "places" else "n").to_pylist()
        windows = rows.column("windows").to_pylist() if kind != "keys" else None
        if windows:
            assert sum(n * w for n, w in zip(counts, windows, strict=True)) == len(data) - R.WIDTH + 1
