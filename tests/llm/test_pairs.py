"""Near-duplicates, top-k search and components."""

import random

import numpy as np
import pytest

from jobreview.llm import near_dups, shard_cells, topk
from jobreview.llm import sketch_pairs as P
from jobreview.llm.components import components
from jobreview.llm.kdtree import KDTree


def sets_of(texts, n_words):
    out = []
    for text in texts:
        words = (text or "").lower().split()
        runs = {tuple(words[i : i + n_words]) for i in range(len(words) - n_words + 1)}
        out.append(runs or ({tuple(words)} if words else set()))
    return out


def brute_groups(texts, n_words):
    sets = sets_of(texts, n_words)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize("n_words", [2, 5])
def test_groups_equal_brute_force(frame, n_words):
    rng = random.Random(n_words)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts = ["", None, "one", "ONE", "a b c d", "a b c d e", "x a b c d e", "a b c d e f"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 90, 300]))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy + passage * rng.randint(0, 1)))
    root, sizes = brute_groups(texts, n_words)
    rows = near_dups.mark_near_duplicates(frame(texts), n_words=n_words).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == root
    assert [r["n_shingles"] for r in rows] == sizes
    assert [r["kept"] for r in rows] == [i == r for i, r in enumerate(root)]


def test_small_sets_at_the_border(frame):
    """Sets of 1 to 12, the fewest shared values for a link and one fewer, in
    several orders of the hashes; texts of the next length by shingles."""
    texts, draw = [], 0
    for a in range(1, 13):
        for b in range(a, 13):
            least = next((s for s in range(1, a + 1) if 100 * s >= 80 * (a + b - s)), a)
            for shared in {least, least - 1}:
                for _ in range(5):
                    draw += 1
                    common = [f"c{draw}_{i}" for i in range(shared)]
                    texts += [" ".join(common + [f"{x}{draw}_{i}" for i in range(n - shared)]) for x, n in (("a", a), ("b", b))]
    root, _ = brute_groups(texts, 1)
    rows = near_dups.mark_near_duplicates(frame(texts), n_words=1).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == root
    for n_words in (2, 5):
        texts = [" ".join(f"v{k}_{i}" for i in range(n + n_words - 1 + more)) for k, n in enumerate(range(1, 12)) for more in (0, 1)]
        root, _ = brute_groups(texts, n_words)
        rows = near_dups.mark_near_duplicates(frame(texts), n_words=n_words).orderBy("doc_id").collect()
        assert [r["component_id"] for r in rows] == root


def test_blocks_of_long_lists(frame, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(6, 20))]) for _ in range(25)]
    root, _ = brute_groups(texts, 2)
    rows = near_dups.mark_near_duplicates(frame(texts), n_words=2).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == root


def test_null_and_repeated_ids(frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = near_dups.mark_near_duplicates(frame([text, text, text, None], [None, 4, 4, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [
        ("4", "4", True), ("4", "4", True), ("None", "4", False), ("None", "None", True),
    ]
    assert near_dups.mark_near_duplicates(frame([])).count() == 0
    assert near_dups.drop_near_duplicates(frame([text, text])).collect()[0]["doc_id"] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (3, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_bounds_and_answers():
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (500, 8)).astype(float)
    points[100:300] = points[100]
    ids = rng.permutation(500)
    tree = KDTree(points, ids, leaf=8)
    queries = rng.integers(-50, 50, (20, 8)).astype(float)
    bounds = tree.bounds(queries)
    for q, b in zip(queries, bounds, strict=True):
        scores = sorted(((-float(p @ q), int(i)) for p, i in zip(points, ids, strict=True)))
        assert b[0] >= -scores[0][0]
        assert tree.search(q, -1, 5, b, -np.inf) == [(-s, i) for s, i in scores[:5]]


def test_top_k_equals_brute_force(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(3, rows[3][1])]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (None, rows[1][1]), (450, [1e30] * 6), (500, [0.5]), (501, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=40, query_block=2).collect()
    good = {i: [int(np.floor(256 * x)) if abs(x) < 1e9 else int(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    limit = (1 << 63) - 1
    for q in [i for i in good if i % 50 == 0 and i != 450]:  # its scores are all cut
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        expected = [(k + 1, i, max(-limit, min(limit, -s))) for k, (s, i) in enumerate(scores[:5])]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == expected
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def exact_answers(rows, k=5):
    good = {i: np.floor(256 * np.asarray(v)).astype(int) for i, v in rows}
    ids = np.array(sorted(good))
    points = np.array([good[i] for i in ids])
    out = {}
    for q in ids[ids % 50 == 0]:
        scores = points @ good[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), int(scores[i])) for i in order]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sample", [1 << 22, 600, 1])
def test_top_k_with_cells_from_a_sample_and_a_hot_vector(spark, monkeypatch, sample):
    """Cells fit on all rows, on some, on none; a third of the rows are equal."""
    from pyspark.sql import functions as F

    fit = shard_cells.fit_splits
    monkeypatch.setattr(topk, "fit_splits", lambda rows, n: fit(rows, n, sample))
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=5) + 6 * (i % 4)]) for i in range(800)]
    rows += [(i, rows[3][1]) for i in range(800, 1200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vectors.withColumns({name: F.lit(1) for name in ("cell", "part", "block", "vec", "floor")})
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=60, query_block=3)
    assert answers(found) == exact_answers(rows)


def test_queries_go_only_to_shards_whose_box_reaches_their_floor(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 40
    rows = [(i, [float(x) for x in centres[i % 16] + rng.normal(size=8)]) for i in range(3200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dealt = vectors.select("vec_id", topk.scaled(F.col("embedding")).alias("vec"))
    splits = shard_cells.fit_splits(dealt, 200)
    dealt = dealt.withColumn("cell", shard_cells.cell_of(splits, F.col("vec")))
    sizes = [r["count"] for r in dealt.groupBy("cell").count().collect()]
    assert sum(sizes) == 3200 and max(sizes) <= 200
    boxes = shard_cells.fit_boxes(dealt)
    fifth = {q: found[-1][1] for q, found in exact_answers(rows).items()}
    floors = spark.createDataFrame(list(fifth.items()), "vec_id long, floor long")
    cells = shard_cells.reached_cells(boxes, F.col("vec"), F.col("floor"))
    reached = dealt.join(floors, "vec_id").select(F.size(cells).alias("n")).agg(F.sum("n")).first()[0]
    assert len(fifth) <= reached < len(fifth) * len(sizes) / 4


def test_pairs_do_not_depend_on_batches(monkeypatch):
    """Lists cut by batches, and few pairs at a time, give the same pairs."""
    import pyarrow as pa

    from jobreview.llm import sketch_pairs

    rng = np.random.default_rng(4)
    names = ("key", "i", "j", "own", "at", "n", "a", "b", "root", "sketch")
    rows = []
    for key in range(12):
        base = np.sort(rng.integers(-(2**31), 2**31 - 1, 256))
        for node in range(1 + key % 5):
            rows.append((key, 0, key % 2, node % 2 if key % 2 else 0, int(base[0]), 400, 9 - node, key, node, base.tolist()))
    kinds = [pa.int64()] * 9 + [pa.list_(pa.int32())]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    expected = sorted(
        tuple(x for r in sorted((rows[x], rows[y]), key=lambda r: r[6:8]) for x in r[6:8])
        for y in range(len(rows)) for x in range(y)
        if rows[x][0] == rows[y][0] and (rows[x][0] % 2 == 0 or rows[x][3] != rows[y][3])
    )
    for size, pairs in ((100, 1 << 19), (3, 2), (1, 1)):
        monkeypatch.setattr(sketch_pairs, "PAIRS", pairs)
        out = pa.Table.from_batches(list(sketch_pairs.compared(iter(table.to_batches(size)), 80)))
        assert sorted(tuple(r.values()) for r in out.to_pylist()) == expected


@pytest.mark.parametrize("filter_words", [near_dups.MAX_FILTER_WORDS, 0])
def test_lists_of_several_nodes(spark, monkeypatch, filter_words):
    monkeypatch.setattr(near_dups, "MAX_FILTER_WORDS", filter_words)
    frames = {}
    plain = near_dups.written
    monkeypatch.setattr(near_dups, "written", lambda df, purpose: frames.setdefault(purpose, plain(df, purpose)))
    rng = random.Random(3)
    rows = [(rng.randrange(40), 5, (i % 30, i % 30), 9) for i in range(60)] + [(100 + i, 6, (i, i), 7) for i in range(200)]
    rows += [(99, 5, (1, 1), 9)] * 2
    keys = spark.createDataFrame(rows, "key long, at int, node struct<a:long,b:long>, n long")
    got = sorted(tuple(r) for r in near_dups._members(keys).select("key", "node.a", "first.node.a", "first.n").collect())
    lists = {}
    for key, _, node, n in rows:
        lists.setdefault(key, []).append((*node, n))
    expected = [(k, a, min(v)[0], min(v)[2]) for k, v in lists.items() if len({x[:2] for x in v}) > 1 for a, _, _ in v]
    assert got == sorted(expected)
    assert frames["sketch-listed"].filter("key >= 100").count() == 0, "keys that occur once are not shuffled as rows"


def test_pairs_of_a_list_equal_the_definition():
    rng = np.random.default_rng(8)
    base = np.sort(rng.choice(1 << 20, 300, replace=False))
    sketches, n = np.full((60, P.SKETCH), P.END, np.int64), np.zeros(60, np.int64)
    for k in range(60):
        own = base[rng.random(300) < rng.choice([0.5, 0.8, 0.95])][: rng.choice([5, 40, 256])]
        sketches[k, : len(own)], n[k] = own, len(own)
    group, root, side = np.repeat([0, 1], 30), rng.integers(0, 25, 60), np.zeros(60, np.int64)
    at = np.repeat(base[[12, 40]], 30)
    got = {(int(i), int(j)) for x, y in P.list_pairs(group, at, n, root, sketches, side, 80) for i, j in zip(x, y, strict=True)}

    def runs(k):
        own = sketches[k][: P.RUN_SKETCH]
        return {tuple(own[i : i + 3]) for i in range(P.RUN_SKETCH - 2) if own[i + 2] < P.END}

    expected = set()
    for i in range(60):
        for j in range(i + 1, 60):
            earlier = n[i] > P.SMALL_SET and any(run[0] < at[i] for run in runs(i) & runs(j))
            fits = group[i] == group[j] and root[i] != root[j] and min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 80
            if fits and not earlier:
                estimate = P.estimates(sketches[[i]], sketches[[j]]) >= P.least_estimates(n[[i]], n[[j]], 80)
                expected |= {(i, j)} if estimate[0] else set()
    assert got == expected != set()
