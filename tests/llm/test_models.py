import zlib

import numpy as np

from evistrata.llm import quality, toxicity
from evistrata.llm.doc_stats import NAMES, stats

SF = "/root/testdata/sf0.01"


def test_stats_of_awkward_texts():
    for t in (None, "", " \n", "x" * 100_000, "!!!", "a b " * 20_000):
        got = stats(t)
        assert len(got) == len(NAMES) and np.isfinite(got).all()


def test_pool_adjacent():
    got = quality.pool_adjacent(np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 1]))
    assert np.allclose(got, [1, 2.25, 2.25, 2.25, 4.5, 4.5])


def test_normal_equations_match_one_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(NAMES)))
    y = (x[:, 0] > 0).astype(int)
    model = quality.fit(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, label int").repartition(5))
    z = model.features(x)
    penalty = np.r_[0, np.ones(z.shape[1] - 1)] * quality.RIDGE * len(x) / quality.FEATURES
    whole = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    assert np.allclose(z @ whole, model.raw(x), atol=1e-6)
    s = model.score(x)
    assert ((s >= 0) & (s <= 1)).all() and (np.diff(s[np.argsort(model.raw(x))]) >= -1e-12).all()


def test_kernel_is_approximated():
    rng = np.random.default_rng(1)
    k, n = len(NAMES), 4000
    model = quality.QualityModel(np.zeros(k), np.ones(k), rng.normal(size=(k, n)) / 3.0, rng.uniform(0, 2 * np.pi, n), np.zeros(1), np.zeros(1), np.zeros(1))
    a, b = rng.normal(size=(2, k))
    fa, fb = model.features(np.vstack([a, b]))[:, 1 + k :]
    assert abs(fa @ fb - np.exp(-((a - b) ** 2).sum() / (2 * 9.0))) < 0.05


def check(found, labels, column, modulus, rest):
    label = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in found if r.held_out]
    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1
    right = [r.predicted == label[r.doc_id] for r in held if r.doc_id in label]
    return sum(right) / len(right)


def test_quality_is_learned(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).collect()
    assert len(found) == docs.count() and check(found, labels, "quality", 4, 2) > 0.95
    assert quality.classify(awkward, labels).count() == 10 and quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}


def test_toxicity_is_learned(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == docs.count() and check(found, labels, "toxic", 5, 0) > 0.85
    assert toxicity.classify(awkward, labels).count() == 10 and toxicity.classify(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(awkward, labels.limit(0)).collect()} == {0}


def test_nnpu_separates(spark):
    rng = np.random.default_rng(3)
    positive = [[0, int(rng.integers(2, 30))] for _ in range(100)]
    other = [[0, int(rng.integers(2, 30))] if i % 5 == 0 else [1, int(rng.integers(2, 30))] for i in range(1000)]
    rows = spark.createDataFrame([(True, x) for x in positive] + [(False, x) for x in other], "toxic boolean, ids array<int>").repartition(3)
    seen = np.bincount(np.concatenate(positive), minlength=30).astype(float)
    w, b = toxicity.nnpu(rows, seen, 100, 1100, 0.2)
    assert w[0] + b > 0 > w[1] + b
    for side, some in ((0, positive + other), (1, positive)):  # the sums are those of a loop over all rows
        z = np.array([b + w[x].sum() for x in some])
        want = np.zeros(32)
        for x, s in zip(some, 1 / (1 + np.exp(-z)), strict=True):
            want[x] += s
            want[30] += s
        want[31] = np.logaddexp(0, z).sum()
        assert np.allclose(toxicity._sums(rows, w, b)[side], want)


def test_toxic_words_are_counted_over_all_texts(spark):
    ids = [r.doc_id for r in spark.range(400).toDF("doc_id").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
    toxic = set(ids[::2])
    docs = spark.createDataFrame([(d, "common vile" + " rarity" * (i >= 60) if d in toxic else "common plain") for i, d in enumerate(ids)] + [(None, "common vile")], "doc_id long, text string")
    known = spark.createDataFrame([(d, int(d in toxic)) for d in ids], "doc_id long, label int")
    model = toxicity.fit(docs, known)
    assert {"vile", "rarity", "plain"} <= set(model.vocabulary)
    got = {(r.word): (r.dp, r.du) for r in toxicity._count_words(spark.createDataFrame([(True, "a b"), (False, "b B"), (False, None)], "toxic boolean, text string")).collect()}
    assert got == {"": (1, 3), "a": (1, 1), "b": (1, 2)}


def test_numbers_of_a_text_are_those_of_its_features(monkeypatch):
    from evistrata.llm import toxicity

    monkeypatch.setattr(toxicity, "PARTIAL", 3)
    texts = ["The hateful hat, the HATS and a hat", "", None, "x" * 50 + " ab abc abcd", "é éé ééé hating"]
    words = sorted(set().union(*map(toxicity.features, texts)))
    number = {w: i for i, w in enumerate(words[::2])}
    numbers = toxicity._Numbers(number)
    assert [numbers.of_text(t) for t in texts] == [sorted(number[w] for w in toxicity.features(t) if w in number) for t in texts]
