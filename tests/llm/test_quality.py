import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_ranked(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.fit(docs, labels.where("doc_id % 5 <> 0"), per_class=200)
    held = quality.score(docs, ranking).join(labels, "doc_id").where("doc_id % 5 = 0").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in held)


def test_weights_minimise_the_loss():
    draw = np.random.default_rng(1)
    better, worse = draw.normal(0.5, 1, (300, 3)), draw.normal(0, 1, (300, 3))
    loss = lambda w: np.log1p(np.exp(-(better - worse) @ w)).sum() + 0.5 * w @ w
    w = quality.bradley_terry(better, worse)
    assert all(loss(w) <= loss(w + d) for d in draw.normal(0, 0.01, (50, 3)))


def test_features_are_finite():
    texts = [None, "", " ", "x", "\n\n", "!!!", "a " * 100_000, "|" * 9, "\ud83d\ude42", "Word. " * 3]
    rows = [quality.features(t) for t in texts]
    assert all(len(r) == len(quality.FEATURES) and np.isfinite(r).all() for r in rows)


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame(
        [(i, "a plain sentence of some words here. " * (1 + i % 3), 1.0) for i in range(20)] + [(i, "JUNK!! " * 9, 1.0) for i in range(20, 40)]
        + [(40, None, 1.0), (41, "", None), (None, "plain words.", 1.0), (1, "repeated id", 1.0), (1, "repeated id", 1.0), (42, "w " * 200_000, 1.0)],
        "doc_id long, text string, SCORE double",
    )
    rows = [(i, int(i < 20)) for i in range(40)] + [(3, 1), (3, 0), (None, 1), (4, None), (5, 7), (999, 1)]
    labels = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, text string")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and got[0].__fields__ == ["doc_id", "text", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.score for r in got[20:40]]) < np.mean([r.score for r in got[:20]])
    with pytest.raises(ValueError):
        quality.fit(docs, labels.where(F.col("quality") == 1))
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


def _tables(spark, tmp_path, name, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    return str(tmp_path / name)


def test_query_learns_from_the_given_split_only(spark, tmp_path):
    """The registered query: its split recomputed, held-out labels without influence, and right about them."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    got = {r.doc_id: r for r in quality.op1(spark, SF).collect()}
    other = {r.doc_id: r for r in quality.op1(spark, _tables(spark, tmp_path, "turned", turned)).collect()}
    assert got.keys() == other.keys() and len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    assert all(abs(got[d].score - other[d].score) < 1e-9 for d in got)
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_scores_against_a_plain_fit(spark):
    """All pairs of a small sample, gradient steps and a loop over documents, instead of Newton steps on arrays."""
    rows = [(i, ("a plain sentence of some words here. " * (1 + i % 4)) + "x" * (i % 5)) for i in range(30)] + [(i, "JUNK!! 99 " * (3 + i % 7)) for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    ranking = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, ranking).collect()}
    values = np.array([quality.features(t) for _, t in rows])
    centre, scale = values.mean(axis=0), np.maximum(values.std(axis=0), 1e-6)
    assert np.allclose(centre, ranking.centre) and np.allclose(scale, ranking.scale)
    z = quality._expanded(values, centre, scale)
    pairs = np.array([a - b for a in z[:30] for b in z[30:]])
    weights = np.zeros(pairs.shape[1])
    for _ in range(2000):
        weights += 0.05 * ((pairs / (1 + np.exp(np.clip(pairs @ weights, -30, 30)))[:, None]).mean(axis=0) - weights / (2 * len(pairs)))
    raw = z @ weights
    assert min(raw[:30]) > max(raw[30:]) and min(scores[i] for i in range(30)) > max(scores[i] for i in range(30, 60))
    assert all((scores[i] >= 0.3) == (i < 30) for i in range(60))


def test_a_repeated_fit_is_the_same(spark):
    rows = [(i % 10, f"some words and number {i} " * (1 + i % 3)) for i in range(200)] + [(10 + i % 10, f"JUNK {i} !!") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, quality int")
    fits = [quality.fit(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels, per_class=10) for step, n in ((1, 3), (-1, 5))]
    assert np.allclose(fits[0].weights, fits[1].weights)


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """Centre and cut are those of all rows, not of some thousands; groups hold both labels and every row."""
    rows = [(i, ("plain words " * (1 + i % 40)) + "x" * (i % 7)) for i in range(9000)] + [(i, "JUNK!! 99 " * (1 + i % 50)) for i in range(9000, 10_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 9000)) for i in range(10_500)], "doc_id long, quality int")
    ranking = quality.fit(docs, labels)
    values = np.array([quality.features(t) for _, t in rows])
    assert np.allclose(ranking.centre, values.mean(axis=0))
    raw = np.sort(ranking.raw(values))
    assert ranking.cut == pytest.approx((raw[1499] + raw[1500]) / 2)
    monkeypatch.setattr(quality, "FEW_IDS", 0)
    monkeypatch.setattr(quality, "MOST_VALUES", 10)
    again = quality.fit(docs, labels)
    assert np.allclose(again.weights, ranking.weights) and again.cut == pytest.approx(ranking.cut)
    dealt = quality._dealt(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), {0: 1500, 1: 9000})
    assert dealt.where("label = 1").count() == 9000 and dealt.select("id").distinct().count() == 10_500
    sizes = dealt.groupBy("part", "label").count().collect()
    assert len(sizes) == 2 * 3 and max(r["count"] for r in sizes) < 2 * quality.GROUP_COMMON
