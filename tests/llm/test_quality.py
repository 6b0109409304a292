"""The factorisation machine against sums over all pairs, and on texts of two kinds."""

import numpy as np
import pytest

from quadrat.llm import quality


def plain(model, found, column):
    """The margin of one text, pair by pair."""
    place, value, stats = found
    x = {}
    for p, v in zip(place.tolist(), value.tolist()):
        x[p] = x.get(p, 0) + v
    for k, (s, border) in enumerate(zip([*stats, *column], model.borders)):
        kind = quality.CLASSES if np.isnan(s) else sum(b <= s for b in border)
        x[quality.HASHED + k * (quality.CLASSES + 1) + kind] = len(model.borders) ** -0.5
    at = list(x)
    pairs = sum(x[i] * x[j] * float(model.vectors[i] @ model.vectors[j]) for n, i in enumerate(at) for j in at[:n])
    return model.bias + sum(model.weights[i] * x[i] for i in at) + pairs


def test_sums_of_squares_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    n = quality.HASHED + (len(quality.STATISTICS) + 1) * (quality.CLASSES + 1)
    borders = [np.sort(rng.random(quality.CLASSES - 1)) for _ in range(len(quality.STATISTICS) + 1)]
    model = quality.Model(0.3, rng.normal(size=n), rng.normal(size=(n, quality.FACTORS)), borders)
    texts = ["One two two three!! THREE", "", None, "the same the same\nthe same", "x1 &&& y-2 ñandú"]
    columns = np.array([[0.5], [np.nan], [1.0], [0.0], [0.25]])
    found = [quality.features(t) for t in texts]
    odds = model.margins(model.rows(found, columns))[0]
    assert np.allclose(odds, [plain(model, f, c) for f, c in zip(found, columns)])
    assert np.allclose(model.score(texts, columns), 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    some = model.rows(found, columns).take(np.array([3, 0]))
    assert np.allclose(model.margins(some)[0], odds[[3, 0]])


def test_features_of_parts(monkeypatch):
    text = "Alpha beta beta\nGamma 12 beta\n" * 30
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PART", 7)
    for a, b in zip(whole, quality.features(text)):
        assert np.allclose(a, b)
    assert quality.hashed("AbC9")[0] == quality.hashed("aBc9")[0] and quality.hashed("Ab!!")[1] == quality.hashed("Zz!")[1] == quality.hashed("Éa!")[1]


def table(spark, n=400):
    rng, rows, marks = np.random.default_rng(1), [], []
    for i in range(n):
        some = [f"w{int(x)}" for x in rng.integers(0, 50, 40)]
        bad = i % 4 == 0
        text = " ".join(w + "%%%" if bad and rng.random() < 0.7 else w for w in some)
        rows.append((i, text, "en", len(text)))
        marks.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int"), dict(marks)


def test_learns_and_holds_out(spark):
    docs, labels, marks = table(spark)
    model = quality.trained(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i, r in found.items() if r.held_out]
    import zlib

    assert held == [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0] and len(held) > 40
    assert np.mean([found[i].predicted == marks[i] for i in held]) > 0.95
    # labels of held-out rows are not read
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(docs, quality.trained(docs, turned)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in found.items())


@pytest.mark.parametrize("column", ["n_chars", "other"])
def test_odd_rows(spark, column):
    docs, labels, _ = table(spark, 80)
    model = quality.trained(docs, labels, (column,))
    odd = [(1, None, None), (None, "w1 w2", 3), (2, "", 0), (2, "", 0), (3, "long " * 300_000, 5), (4, "  ", None)]
    rows = quality.score(spark.createDataFrame([(*r, 1.0, "q") for r in odd], "doc_id long, text string, n_chars long, score double, `a.b` string"), model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_few_labels(spark):
    docs, labels, _ = table(spark, 40)
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.filter("quality = 0")):
        scores = {r.score for r in quality.score(docs, quality.trained(docs, some)).collect()}
        assert len(scores) == 1 and 0 <= min(scores) <= 1
    bound = quality.trained(docs, labels, sample={0: 3, 1: 5}, most=100_000)
    assert len(bound.weights)
