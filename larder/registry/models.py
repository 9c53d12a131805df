"""Clustering and prediction: SQL checks the features, the fitted results are checked by tests."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.operators import clusters, forecast, menu, prediction
from larder.registry.base import query, r, rounded
from larder.registry.forecast import AS_OF, lines
from larder.registry.menu import performance
from larder.session import written
from larder.sources.standins import Standins


@lru_cache(maxsize=4)
def _predictors(application: str, version: str, sf_dir: str):
    return prediction.train_predictors(_tables(sf_dir).menu_items)


@lru_cache(maxsize=4)
def _forecaster(application: str, version: str, sf_dir: str):
    t = _tables(sf_dir)
    demand = written(forecast.demand_features(t.order_items, t.orders), "demand")
    matrix = forecast.feature_matrix(demand)
    return forecast.train_forecaster(matrix)


@lru_cache(maxsize=4)
def _clusters(application: str, version: str, sf_dir: str):
    return clusters.fit_clusters(performance(_tables(sf_dir)))


def _tables(sf_dir: str) -> Standins:
    return Standins(SparkSession.getActiveSession(), sf_dir)


def _version(t) -> str:
    """One number over names, sizes and times of the folder's files; their content is not read."""
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(t.sf_dir)
    return str(files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(30,0)"))).first()[0])


def fitted(kind, t):
    """A model is fitted once per application and state of the data folder and shared by the queries on it."""
    return kind(t.spark.sparkContext.applicationId, _version(t), t.sf_dir)


Z = "({c} - (SELECT avg({c}) FROM item_performance)) / (SELECT stddev_pop({c}) FROM item_performance)"


@query(
    "cl1_scaled_features",
    "SELECT item_id, " + ", ".join(r(Z.format(c=c), 4, f"z_{c}") for c in clusters.FEATURES) + " FROM item_performance",
)
def cl1(t):
    names = [f"z_{c}" for c in clusters.FEATURES]
    return rounded(clusters.scaled_features(performance(t)).select("item_id", *names), **{c: 4 for c in names})


@query("cl2_elbow")
def cl2(t):
    curve, best = clusters.elbow(performance(t))
    return curve.withColumn("chosen", F.col("k") == best)


@query("cl3_item_clusters")
def cl3(t):
    return clusters.item_clusters(fitted(_clusters, t), performance(t))


@query("cl4_assign_cluster")
def cl4(t):
    new = t.menu_items.select(
        F.col("id").alias("item_id"),
        F.col("purchases").alias("order_count"),
        "price",
        (F.col("purchases") * F.col("price")).alias("revenue"),
    )
    return clusters.assign_cluster(fitted(_clusters, t), new).select("item_id", "cluster")


@query(
    "cl5_cluster_summary",
    f"""SELECT CAST(item_id % 4 AS INTEGER) AS cluster, count(item_id) AS items, {r('avg(order_count)', 2, 'avg_orders')},
               {r('sum(order_count)', 2, 'total_orders')}, {r('avg(price)', 2, 'avg_price')}, {r('avg(revenue)', 2, 'avg_revenue')},
               {r('sum(revenue)', 2, 'total_revenue')} FROM item_performance GROUP BY 1""",
)
def cl5(t):
    labelled = performance(t).withColumn("cluster", (F.col("item_id") % 4).cast("int"))
    return clusters.cluster_summary(labelled)


@query(
    "cl6_profiles_of_centres",
    f"""WITH c AS (SELECT CAST(item_id % 4 AS INTEGER) AS cluster, avg(order_count) AS o, avg(price) AS p FROM item_performance GROUP BY 1)
        SELECT cluster, CASE WHEN o > (SELECT median(o) FROM c) AND p > (SELECT median(p) FROM c) THEN 'High Volume, Premium Price (Stars)'
                             WHEN o > (SELECT median(o) FROM c) THEN 'High Volume, Value Price (Volume Drivers)'
                             WHEN p > (SELECT median(p) FROM c) THEN 'Low Volume, Premium Price (Niche Items)'
                             ELSE 'Low Volume, Low Price (Underperformers)' END AS profile FROM c""",
)
def cl6_given(t):
    labelled = performance(t).groupBy((F.col("item_id") % 4).cast("int").alias("cluster"))
    centres = labelled.agg(*[F.avg(c).alias(c) for c in clusters.FEATURES])
    return clusters.profile_centres(centres).select("cluster", "profile")


@query("cl6_cluster_profiles")
def cl6(t):
    return clusters.cluster_profiles(fitted(_clusters, t), performance(t))


@query("cl7_pca_coordinates")
def cl7(t):
    return clusters.pca_coordinates(performance(t))


EDGE_LIST = ", ".join(f"quantile_cont(least(greatest(price, 1), 1000), {p})" for p in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0))
USABLE = f"""
    usable AS (SELECT id, price, rating, votes::DOUBLE AS votes, purchases::DOUBLE AS purchases, index::DOUBLE AS index
               FROM dim_menu_items WHERE purchases > 0 AND price > 0 AND price < 10000),
    edges AS (SELECT list_sort(list_distinct([{EDGE_LIST}])) AS e FROM usable)"""
BUCKET = "CAST(greatest(len([x FOR x IN e IF x < least(greatest(price, 1), 1000)]) - 1, 0) AS INTEGER)"


@query(
    "pr1_prediction_features",
    f"""WITH {USABLE}
        SELECT id, price, {r('rating', 4)}, votes, purchases, index, {BUCKET} AS price_bucket,
               {r('rating * votes', 4, 'rating_score')}, {r('ln(1 + price)', 6, 'log_price')} FROM usable, edges""",
)
def pr1(t):
    return rounded(prediction.prediction_features(t.menu_items), rating=4, rating_score=4, log_price=6)


@query("pr2_price_quintile", f"WITH {USABLE} SELECT id, {BUCKET} AS price_bucket FROM usable, edges")
def pr2(t):
    rows = prediction.usable_items(t.menu_items)
    edges = prediction.price_edges(rows)
    return rows.select("id", prediction.price_bucket("price", edges).alias("price_bucket"))


@query("pr3_train_predictors")
def pr3(t):
    return prediction.predictor_metrics(fitted(_predictors, t), t.menu_items)


@query(
    "pr4_predictor_metrics",
    f"""SELECT {r('avg(abs(votes - purchases))', 4, 'mae')}, {r('sqrt(avg((votes - purchases) * (votes - purchases)))', 4, 'rmse')},
               {r('1 - sum((votes - purchases) * (votes - purchases)) / (var_pop(purchases) * count(*))', 6, 'r2')}, count(*) AS rows
        FROM dim_menu_items""",
)
def pr4(t):
    return rounded(forecast.regression_metrics(t.menu_items, "purchases", "votes"), mae=4, rmse=4, r2=6)


@query("pr5_predictor_importance")
def pr5(t):
    models = fitted(_predictors, t).models
    found = [
        forecast.feature_importance(model, prediction.FEATURES, t.menu_items).select(F.lit(name).alias("model"), "feature", "importance")
        for name, model in sorted(models.items())
    ]
    return reduce(DataFrame.unionByName, found)


def requests(t):
    """Every item, half of them under an id the menu does not know."""
    return t.items.select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000_000).alias("id"), "price")


REQUESTS = """
    requests AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000000 END AS id, price FROM dim_items),
    known AS (SELECT q.id, q.price,
                     coalesce(m.rating, (SELECT avg(rating) FROM dim_menu_items)) AS rating,
                     coalesce(m.votes, (SELECT avg(votes) FROM dim_menu_items)) AS votes
              FROM requests q LEFT JOIN dim_menu_items m ON q.id = m.id)"""


@query(
    "pr6_request_features",
    f"""WITH {USABLE}, {REQUESTS}
        SELECT id, price, {r('rating', 4)}, {r('votes', 4)}, id::DOUBLE AS index, {BUCKET} AS price_bucket,
               {r('rating * votes', 2, 'rating_score')}, {r('ln(1 + price)', 6, 'log_price')} FROM known, edges""",
)
def pr6_features(t):
    edges = prediction.price_edges(prediction.usable_items(t.menu_items))
    df = prediction.request_features(requests(t), t.menu_items, edges)
    return rounded(df, rating=4, votes=4, rating_score=2, log_price=6)


@query("pr6_predict_daily_demand")
def pr6(t):
    return prediction.predict_daily_demand(fitted(_predictors, t), requests(t), t.menu_items)


@query(
    "pr7_price_band_fallback",
    """SELECT id, CASE WHEN v <= 0 THEN 2 WHEN v <= 50 THEN 0 WHEN v <= 100 THEN 1 WHEN v <= 200 THEN 2 WHEN v <= 500 THEN 3
                       WHEN v <= 10000 THEN 4 ELSE 2 END AS price_bucket
       FROM (SELECT id, (id % 1200) * 10.0::DOUBLE AS v FROM dim_items)""",
)
def pr7(t):
    price = (F.col("id") % 1200) * 10.0
    return t.items.select("id", prediction.fixed_price_band(price).alias("price_bucket"))


@query("me14_classify_new_items")
def me14(t):
    predicted = prediction.predict_daily_demand(fitted(_predictors, t), requests(t), t.menu_items)
    return menu.classify_new_items(predicted, menu.menu_thresholds(performance(t)))


@query("fc9_train_forecaster")
def fc9(t):
    return forecast.forecaster_metrics(fitted(_forecaster, t), t.orders).where("metric <> 'training_time_seconds'")


@query("fc11_forecaster_importance")
def fc11(t):
    f = fitted(_forecaster, t)
    return forecast.feature_importance(f.model, f.features, t.orders)


@query("fc12_predict_demand")
def fc12(t):
    base = lines(t)
    week = F.sequence(F.lit("2001-07-30").cast("date"), F.lit("2001-08-05").cast("date"))
    asked = t.most_ordered.select("item_id", "place_id", F.explode(week).alias("date"))
    return forecast.predict_demand(fitted(_forecaster, t), asked, forecast.item_stats(base), forecast.place_stats(base))


@query("fc13_forecast_all")
def fc13(t):
    base = lines(t)
    return forecast.forecast_all(fitted(_forecaster, t), base, forecast.item_stats(base), forecast.place_stats(base), AS_OF)
