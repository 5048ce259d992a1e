"""Toxicity and the pipeline."""

import random

import corpus_pipeline
from jobreview.llm import toxicity as tox
from jobreview.llm.common import table


def test_features_are_stable():
    lexicon = tox.Lexicon({"blark": 2.0}, {"gromb": 3.0})
    zero = tox.features_of(None, lexicon)
    assert zero == tox.features_of("", lexicon) == [0.0] * len(tox.FEATURES)
    values = dict(zip(tox.FEATURES, tox.features_of("You BLARK grombulous 1d10t idiot!!", lexicon), strict=True))
    assert values["insults"] > 0 and values["learned_words"] > 0 and values["learned_beginnings"] > 0
    assert values["near_second_person"] > 0 and values["obfuscated"] > 0 and values["capital_words"] > 0


def toy(spark):
    rng = random.Random(1)
    words = [f"w{i}x" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = rng.choices(words, k=40) + (["blark", "you", "gromble"] * 2 if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toy(spark)
    model = tox.fit_toxicity(docs, labels)
    rows = tox.score_toxicity(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = sum((r["score"] >= tox.THRESHOLD) == (r["doc_id"] % 4 == 0) for r in rows)
    assert right >= 390


def test_without_labels_of_both_kinds(spark):
    docs, labels = toy(spark)
    for rows in (labels.limit(0), labels.filter("toxic = 0")):
        model = tox.fit_toxicity(docs, rows)
        assert {r["score"] for r in tox.score_toxicity(docs, model).collect()} == {0.0}
    assert tox.score_toxicity(docs.limit(0), tox.fit_toxicity(docs.limit(0), labels)).count() == 0


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.count() <= docs.count()
        docs = out
    assert docs.filter("lossless").count() == docs.count() > 0
