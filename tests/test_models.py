"""Clusters and trees: invariants, determinism, save and load."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.functions import labels as L
from larder.operators import clusters, forecast, menu, prediction
from larder.sources import sinks


@pytest.fixture(scope="module")
def items(spark):
    g = np.random.default_rng(42)
    n = 300
    orders = g.exponential(100, n).astype(int) + 1
    price = g.lognormal(4, 0.5, n)
    pdf = pd.DataFrame({"item_id": np.arange(n), "order_count": orders, "price": price, "revenue": orders * price})
    df = spark.createDataFrame(pdf)
    gap = spark.createDataFrame([(9999, 5, None, 10.0)], df.schema)
    return df.unionByName(gap).cache()


def test_elbow(items):
    curve, best = clusters.elbow(items, range(2, 7))
    inertia = [r["inertia"] for r in curve.orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
    assert best == 3 + int(np.argmin(np.diff(inertia)))


def test_clusters(items):
    fitted, again = clusters.fit_clusters(items), clusters.fit_clusters(items)
    labelled = {r["item_id"]: r["cluster"] for r in clusters.item_clusters(fitted, items).collect()}
    assert len(labelled) == 301 and labelled[9999] is None
    assert {v for k, v in labelled.items() if k != 9999} == {0, 1, 2, 3}
    assert labelled == {r["item_id"]: r["cluster"] for r in clusters.item_clusters(again, items).collect()}
    # Every item sits with its nearest centre in scaled units.
    scaler = fitted.model.stages[1]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    centres = (np.array(fitted.centres) - mean) / std
    rows = clusters.complete_rows(items).toPandas()
    z = (rows[clusters.FEATURES].to_numpy(float) - mean) / std
    nearest = np.argmin(((z[:, None, :] - centres[None]) ** 2).sum(-1), axis=1)
    assert all(labelled[i] == c for i, c in zip(rows["item_id"], nearest))
    profiles = clusters.cluster_profiles(fitted, items).collect()
    assert len(profiles) == 4 and {p["profile"] for p in profiles} <= {L.PROFILE_STARS, L.PROFILE_VOLUME, L.PROFILE_NICHE, L.PROFILE_UNDER}


def test_scaled_features_have_unit_spread(items):
    z = clusters.scaled_features(items).toPandas()
    for c in clusters.FEATURES:
        assert abs(z[f"z_{c}"].mean()) < 1e-9 and z[f"z_{c}"].std(ddof=0) == pytest.approx(1)


def test_pca_matches_numpy(items):
    got = clusters.pca_coordinates(items).toPandas().sort_values("item_id")
    rows = clusters.complete_rows(items).toPandas().sort_values("item_id")
    x = rows[clusters.FEATURES].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    for n, name in enumerate(("pc1", "pc2")):
        assert np.allclose(np.abs(got[name]), np.abs(z @ v[n]))


def test_classify_then_cluster(items):
    classified = menu.menu_matrix(items.where("item_id < 9999"))
    fitted = clusters.fit_clusters(classified)
    rows = clusters.item_clusters(fitted, classified)
    assert rows.count() == 300 and {"category", "cluster"} <= set(rows.columns)
    summary = clusters.cluster_summary(rows)
    assert summary.agg(F.sum("items")).first()[0] == 300


@pytest.fixture(scope="module")
def menu_items(spark):
    g = np.random.default_rng(42)
    n = 200
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "price": g.uniform(20, 200, n),
            "rating": g.uniform(3, 5, n),
            "votes": g.integers(0, 100, n),
            "purchases": g.integers(10, 1000, n),
            "index": g.integers(0, 50, n),
        }
    )
    return spark.createDataFrame(pdf).cache()


def test_price_buckets_are_quantiles(menu_items):
    rows = prediction.prediction_features(menu_items).toPandas()
    expected = pd.qcut(rows["price"].clip(1, 1000), 5, labels=False, duplicates="drop")
    assert (rows["price_bucket"] == expected).all()


def test_price_buckets_with_equal_prices(spark):
    prices = [5.0] * 12 + [6.0, 7.0, 8.0, 2000.0, 0.5]
    df = spark.createDataFrame(list(enumerate(prices)), "id int, price double")
    edges = prediction.price_edges(df)
    got = df.select("price", prediction.price_bucket("price", edges).alias("b")).toPandas()
    assert (got["b"] == pd.qcut(got["price"].clip(1, 1000), 5, labels=False, duplicates="drop")).all()


def test_fixed_bands(spark):
    df = spark.createDataFrame([(p,) for p in (-1.0, 0.0, 50.0, 50.1, 200.0, 501.0, 10001.0, None)], "price double")
    assert [r[0] for r in df.select(prediction.fixed_price_band("price")).collect()] == [2, 2, 0, 1, 2, 4, 2, 2]


def test_predictors(spark, menu_items, tmp_path):
    fitted = prediction.train_predictors(menu_items, trees=5)
    assert set(fitted.metrics) == {"random_forest", "gradient_boosting"}
    assert all(np.isfinite(v) for m in fitted.metrics.values() for v in m.values())
    importance = forecast.feature_importance(fitted.models["random_forest"], prediction.FEATURES, menu_items).toPandas()
    assert importance["importance"].sum() == pytest.approx(1) and importance["importance"].is_monotonic_decreasing
    requests = spark.createDataFrame([(1, 50.0), (777, 50.0), (2, None)], "id long, price double")
    rows = prediction.predict_daily_demand(fitted, requests, menu_items).collect()
    assert len(rows) == 3 and all(r["daily_demand"] >= 0.1 for r in rows)
    assert len(prediction.predict_daily_demand(fitted, requests, None, "gradient_boosting", small_batch=True).collect()) == 3
    sinks.save_model(fitted.models["random_forest"], str(tmp_path / "m"))
    again = prediction.FittedPredictors({"random_forest": sinks.load_model(str(tmp_path / "m"))}, fitted.edges)
    assert sorted(map(tuple, prediction.predict_daily_demand(again, requests.dropna(), menu_items).collect())) == sorted(
        tuple(r) for r in rows if r["item_id"] != 2
    )


def test_predictors_learn_from_a_few_tasks(spark, monkeypatch):
    """A pass of a fit takes two tasks a core at most, however many partitions the items come in, and every item."""
    seen, wide = {}, 2 * spark.sparkContext.defaultParallelism + 30
    fit_together = prediction.fit_together

    def watched(session, fits, *rest):
        vectors = fits[0].args[0]
        seen.update(tasks=vectors.rdd.getNumPartitions(), rows=vectors.count())
        return fit_together(session, fits, *rest)

    monkeypatch.setattr(prediction, "fit_together", watched)
    n = F.col("id")
    items = spark.range(0, 4000, 1, wide).select(
        "id", n.alias("index"), (5.0 + n % 40).alias("price"), (3.0 + n % 3).alias("rating"), (n % 90).alias("votes"), (n % 7 + 1).alias("purchases")
    )
    fitted = prediction.train_predictors(items, trees=2)
    assert seen["tasks"] <= wide - 30 and seen["rows"] == items.where(forecast.in_training(["id"])).count()
    assert fitted.models["gradient_boosting"].stages[-1].getNumTrees == 2


def test_boosting_passes_over_few_rows_take_few_tasks(spark, monkeypatch):
    """Boosting takes its hundreds of passes over every item in as few tasks as the rows call for, and learns the same."""
    seen, fit_together = {}, prediction.fit_together

    def watched(session, fits, *rest):
        vectors = fits[1].args[0]
        seen.update(tasks=vectors.rdd.getNumPartitions(), rows=vectors.count())
        return fit_together(session, fits, *rest)

    monkeypatch.setattr(prediction, "fit_together", watched)
    n = F.col("id")
    items = spark.range(0, 4000, 1, 8).select(
        "id", n.alias("index"), (5.0 + n % 40).alias("price"), (3.0 + n % 3).alias("rating"), (n % 90).alias("votes"), (n % 7 + n % 40).alias("purchases")
    )
    training = items.where(forecast.in_training(["id"])).count()
    monkeypatch.setattr("larder.session.BOOST_ROWS", 1000)
    learned = []
    for sampled_from, tasks in ((100, 4), (10_000, 8)):  # the second: so few rows stay as they come
        monkeypatch.setattr(prediction, "SAMPLED_FROM", sampled_from)
        learned.append(prediction.train_predictors(items, trees=3).metrics["gradient_boosting"])
        assert seen["tasks"] == tasks and seen["rows"] <= training and seen["rows"] > 0.9 * training
    assert learned[0] == pytest.approx(learned[1])


def test_thresholds_survive_saving(spark, items, tmp_path):
    edges = menu.menu_thresholds(items)
    sinks.save_thresholds(edges, str(tmp_path / "t"))
    assert sinks.load_thresholds(spark, str(tmp_path / "t")).collect() == edges.collect()


@pytest.mark.parametrize("kind", ["gradient_boosting", "random_forest"])
def test_forecaster(tables, kind):
    lines = forecast.order_lines(tables.order_items, tables.orders)
    demand = forecast.demand_features(tables.order_items, tables.orders)
    fitted = forecast.train_forecaster(forecast.feature_matrix(demand), kind, trees=3, depth=3)
    assert fitted.features == forecast.FEATURES
    total = fitted.metrics["train_samples"] + fitted.metrics["test_samples"]
    assert total == demand.count() and 0.75 < fitted.metrics["train_samples"] / total < 0.85
    stats, places = forecast.item_stats(lines), forecast.place_stats(lines)
    ahead = forecast.forecast_all(fitted, demand, stats, places, dt.date(2001, 8, 1), days=3, top_items=4, max_places=5)
    rows = ahead.collect()
    pairs = {(r["item_id"], r["place_id"]) for r in rows}
    assert len(rows) == len(pairs) * 3 and all(r["predicted_demand"] >= 0 for r in rows)
    assert len({i for i, _ in pairs}) <= 4 and len({p for _, p in pairs}) <= 5
    seen = {tuple(r) for r in demand.select("item_id", "place_id").distinct().collect()}
    assert pairs <= seen
    every = forecast.forecast_requests(demand, stats, dt.date(2001, 8, 1), days=1)
    assert {(r["item_id"], r["place_id"]) for r in every.collect()} == seen
    assert {r["date"] for r in rows} == {dt.date(2001, 8, d) for d in (2, 3, 4)}
    unknown = tables.spark.createDataFrame([(10**9, 1, dt.date(2001, 8, 2))], "item_id long, place_id int, date date")
    assert forecast.predict_demand(fitted, unknown, stats, places).count() == 0
    rows = {r["metric"]: r["value"] for r in forecast.forecaster_metrics(fitted, demand).collect()}
    assert rows["rmse"] >= rows["mae"] > 0


def test_kind_is_checked(tables):
    with pytest.raises(ValueError):
        forecast.train_forecaster(tables.items.select(F.col("price").alias("avg_price"), F.lit(1.0).alias("label")), "lasso")


def test_split_is_the_same_every_time(spark):
    df = spark.range(10_000)
    first = df.where(forecast.in_training(["id"])).count()
    assert first == df.repartition(13).where(forecast.in_training(["id"])).count() and 7_800 < first < 8_200


def test_feature_gaps_take_the_median(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (None, 2.0), (5.0, 3.0), (float("inf"), 4.0), (float("nan"), 5.0)], "avg_price double, quantity_demanded double"
    )
    assert [r["avg_price"] for r in forecast.feature_matrix(df).orderBy("label").collect()] == [1.0, 3.0, 5.0, 3.0, 3.0]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "label double, prediction double")
    row = forecast.regression_metrics(df).first()
    assert row["mae"] == pytest.approx(4 / 3) and row["rmse"] == pytest.approx((10 / 3) ** 0.5)
    assert row["r2"] == pytest.approx(1 - 10 / 8)


def test_passes_of_clustering_run_in_few_tasks(spark, monkeypatch):
    """Rows of 64 small partitions go to two tasks a core; groups and scores are those of one partition."""
    seen = []
    fit = clusters.KMeans._fit
    monkeypatch.setattr(clusters.KMeans, "_fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    rows = [(i, float(100 * (i % 4) + i % 7), float(10 * (i % 4) + i % 3), float(1000 * (i % 4) + i % 11)) for i in range(400)]
    items = spark.createDataFrame(rows, "item_id long, order_count double, price double, revenue double")
    few, many = items.coalesce(1), items.repartition(64)
    tasks = 2 * spark.sparkContext.defaultParallelism
    groups = []
    for given in (few, many):
        labelled = clusters.assign_cluster(clusters.fit_clusters(given), items).collect()
        groups.append({frozenset(r.item_id for r in labelled if r.cluster == k) for k in range(4)})
    clusters.elbow(many, range(2, 4))
    assert groups[0] == groups[1]
    assert seen == [1] + [min(tasks, 64)] * 3
