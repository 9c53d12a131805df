"""Daily demand per item and place, the features on top of it, and the forecasting model."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions.calendar import calendar_fields, order_calendar
from larder.functions.ranks import exact_percentiles
from larder.functions.scalars import finite
from larder.operators.boosting import fit_boosted
from larder.session import fit_tasks, shared_dir, written

# ---- fixed values: features in the order the model knows them ----
FEATURES = [
    "day_of_week",
    "month",
    "week_of_year",
    "is_weekend",
    "avg_price",
    "avg_daily_qty",
    "std_daily_qty",
    "total_orders_restaurant",
    "avg_order_value",
    "lag_7d_avg",
    "lag_14d_avg",
]


def order_lines(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order items with the place, time and calendar of their order; items without an order are left out.

    The join shuffles both sides on the order id. An order that holds a large share of all lines is split by the
    adaptive skew join.
    """
    timed = order_calendar(orders)
    wanted = [
        "place_id",
        "order_datetime",
        "order_date",
        "hour",
        "day_of_week",
        "day_name",
        "month",
        "week_of_year",
        "is_weekend",
    ]
    optional = [c for c in ("total_amount", "type") if c in timed.columns and c not in order_items.columns]
    head = timed.select(F.col("id").alias("order_id"), *wanted, *optional)
    return order_items.join(head, "order_id")


def daily_demand(lines: DataFrame, grain: str = "daily") -> DataFrame:
    """Quantity, mean price, mean cost and orders per place, item and day (or hour, or week), with the calendar.

    The distinct order count follows the join's own partitioning on the order id, so after the join only the small
    per-day partial results are shuffled.
    """
    keys = ["place_id", "item_id", "date"]
    if grain == "daily":
        slot = F.col("order_date")
    elif grain == "hourly":
        slot = F.date_trunc("hour", "order_datetime")
    elif grain == "weekly":
        slot = F.to_date(F.date_trunc("week", "order_datetime"))
    else:
        raise ValueError(f"grain must be daily, hourly or weekly, not {grain}")
    keyed = lines.withColumn("date", slot).where(
        F.col("place_id").isNotNull() & F.col("item_id").isNotNull() & F.col("date").isNotNull()
    )
    per_day = keyed.groupBy(*keys).agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity_demanded"),
        F.avg("price").alias("avg_price"),
        F.avg("cost").alias("avg_cost"),
        F.countDistinct("order_id").alias("num_orders"),
    )
    return per_day.withColumns(calendar_fields(F.to_date("date")))


def item_stats(lines: DataFrame) -> DataFrame:
    """Per item: total, mean and spread of the quantity per order line, mean price, orders.

    avg_daily_qty keeps its customary name although it is the mean per order line.
    """
    return (
        lines.where(F.col("item_id").isNotNull())
        .groupBy("item_id")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_qty"),
            F.avg("quantity").alias("avg_daily_qty"),
            F.coalesce(F.stddev_samp("quantity"), F.lit(0.0)).alias("std_daily_qty"),
            F.avg("price").alias("avg_price"),
            F.countDistinct("order_id").alias("total_orders"),
        )
    )


def place_stats(lines: DataFrame) -> DataFrame:
    """Per place: orders, total quantity and mean line price (customarily called avg_order_value)."""
    return (
        lines.where(F.col("place_id").isNotNull())
        .groupBy("place_id")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_qty"),
            F.avg("price").alias("avg_order_value"),
        )
    )


def enriched_demand(daily: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """Daily demand with the statistics of its item and of its place."""
    return daily.join(
        items.select("item_id", "avg_daily_qty", "std_daily_qty", "total_orders"), "item_id", "left"
    ).join(
        places.select("place_id", F.col("total_orders").alias("total_orders_restaurant"), "avg_order_value"),
        "place_id",
        "left",
    )


def demand_lags(demand: DataFrame) -> DataFrame:
    """Mean demand of the previous 7 and 14 rows of each item and place; the first row takes the item mean.

    A series has one row per day, so a window partition is bounded by the days of history.
    """
    series = Window.partitionBy("item_id", "place_id").orderBy("date")
    return demand.withColumns(
        {
            f"lag_{n}d_avg": F.coalesce(
                F.avg("quantity_demanded").over(series.rowsBetween(-n, -1)), F.col("avg_daily_qty")
            )
            for n in (7, 14)
        }
    )


def demand_base(lines: DataFrame) -> DataFrame:
    """Order lines summed to place, item and day, with what their item and place statistics need.

    Lines without a place or a day keep a row of their own, as they count for their item.
    """
    return (
        lines.where(F.col("item_id").isNotNull())
        .groupBy("place_id", "item_id", F.col("order_date").alias("date"))
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
            F.count("quantity").alias("lines"),
            F.coalesce(F.var_pop("quantity") * F.count("quantity"), F.lit(0.0)).alias("squares"),
            F.coalesce(F.sum("price"), F.lit(0.0)).alias("price_sum"),
            F.count("price").alias("prices"),
            F.avg("cost").alias("avg_cost"),
            F.countDistinct("order_id").alias("orders"),
        )
    )


def _daily_of(base: DataFrame) -> DataFrame:
    return (
        base.where("place_id IS NOT NULL AND date IS NOT NULL")
        .select(
            "place_id",
            "item_id",
            "date",
            F.col("quantity").alias("quantity_demanded"),
            F.try_divide("price_sum", "prices").alias("avg_price"),
            "avg_cost",
            F.col("orders").alias("num_orders"),
        )
        .withColumns(calendar_fields(F.col("date")))
    )


def _items_of(base: DataFrame) -> DataFrame:
    """Item statistics from the daily sums: deviations within days and between days add up to those of the lines."""
    n, total = F.sum("lines"), F.sum("quantity")
    between = F.sum(F.try_divide(F.col("quantity") * F.col("quantity"), F.col("lines"))) - F.try_divide(total * total, n)
    variance = F.try_divide(F.greatest(F.sum("squares") + between, F.lit(0.0)), n - 1)
    return base.groupBy("item_id").agg(
        F.try_divide(total, n).alias("avg_daily_qty"),
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("std_daily_qty"),
        F.sum("orders").alias("total_orders"),
    )


def _places_of(base: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Place statistics: prices from the daily sums, orders from the order ids alone."""
    ids = order_items.where("item_id IS NOT NULL").select("order_id").distinct()
    counts = (
        orders.where("place_id IS NOT NULL")
        .select(F.col("id").alias("order_id"), "place_id")
        .join(ids, "order_id", "left_semi")
        .groupBy("place_id")
        .agg(F.countDistinct("order_id").alias("total_orders"))
    )
    prices = base.groupBy("place_id").agg(F.try_divide(F.sum("price_sum"), F.sum("prices")).alias("avg_order_value"))
    return counts.join(prices, "place_id")


def demand_features(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Daily demand with item, place and lag features: the training table.

    The lines are joined and shuffled once; their daily sums are written to the shared folder, and everything else
    is worked out from them.
    """
    base = written(demand_base(order_lines(order_items, orders)), "demand-base")
    return demand_lags(enriched_demand(_daily_of(base), _items_of(base), _places_of(base, order_items, orders)))


def feature_matrix(demand: DataFrame, target: str = "quantity_demanded") -> DataFrame:
    """The available features in fixed order and the target; gaps and infinities become the column's median.

    One pass counts the gaps. Medians are only worked out for the columns that have any.
    """
    names = [c for c in FEATURES if c in demand.columns]
    clean = {c: finite(c) for c in names}
    gaps = demand.agg(*[F.count_if(v.isNull()).alias(c) for c, v in clean.items()]).first()
    holes = [c for c in names if gaps[c]]
    keys = [c for c in ("place_id", "item_id", "date") if c in demand.columns]
    if holes:
        medians = exact_percentiles(demand, {c: (c, 0.5) for c in holes}).first()
        clean.update({c: F.coalesce(clean[c], F.lit(medians[c])) for c in holes if medians[c] is not None})
    return demand.select(*keys, *[v.alias(c) for c, v in clean.items()], F.col(target).cast("double").alias("label"))


def in_training(keys: list[str], share: float = 0.8, seed: int = 42) -> Column:
    """True for a fixed share of rows by the hash of their keys: the same rows on every run and every retry."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10_000)) < F.lit(int(share * 10_000))


def regression_metrics(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row with MAE, RMSE and R2, in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = p - y
    return predicted.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
        F.count(y).alias("rows"),
    )


@dataclass
class FittedForecaster:
    """A trained pipeline with its feature names and its scores on the held-out rows."""

    model: PipelineModel
    features: list[str]
    metrics: dict[str, float] = field(default_factory=dict)


def train_forecaster(
    matrix: DataFrame,
    kind: str = "gradient_boosting",
    trees: int | None = None,
    depth: int | None = None,
    share: float = 0.8,
    seed: int = 42,
) -> FittedForecaster:
    """Fit boosted trees (200, depth 8, rate 0.1) or a forest (150, depth 12) on 80 % of the feature rows.

    Features are assembled once and cached, so that the many passes of tree training read vectors from memory or
    local disk; a lost executor recomputes its share.
    """
    features = [c for c in FEATURES if c in matrix.columns]
    shared_dir(matrix.sparkSession)  # boosting cuts its lineage there
    if kind == "gradient_boosting":
        learner = GBTRegressor(
            maxIter=trees or 200,
            maxDepth=depth or 8,
            stepSize=0.1,
            minInstancesPerNode=5,
            seed=seed,
            maxMemoryInMB=1024,
            featuresCol="scaled",
        )
    elif kind == "random_forest":
        learner = RandomForestRegressor(
            numTrees=trees or 150,
            maxDepth=depth or 12,
            minInstancesPerNode=3,
            seed=seed,
            maxMemoryInMB=1024,
            featuresCol="scaled",
        )
    else:
        raise ValueError(f"kind must be gradient_boosting or random_forest, not {kind}")
    keys = [c for c in ("place_id", "item_id", "date") if c in matrix.columns]
    marked = matrix.withColumn("training", in_training(keys or features, share, seed))
    prepare = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        ]
    )
    marked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = marked.where("training"), marked.where(~F.col("training"))
        started = time.monotonic()
        prepared = prepare.fit(train)
        train_rows = train.count()
        tasks = fit_tasks(matrix.sparkSession, train_rows, len(features))  # a level of a tree is one short stage over all rows
        vectors = prepared.transform(train).select("label", "scaled")
        if kind == "gradient_boosting":
            fitted = fit_boosted(learner, vectors, train_rows, tasks)
        else:
            vectors = vectors.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                fitted = learner.fit(vectors)
            finally:
                vectors.unpersist()
        seconds = time.monotonic() - started
        model = PipelineModel(stages=[*prepared.stages, fitted])
        scores = regression_metrics(model.transform(test)).first()
    finally:
        marked.unpersist()
    metrics = {
        "mae": scores["mae"],
        "rmse": scores["rmse"],
        "r2": scores["r2"],
        "train_samples": train_rows,
        "test_samples": scores["rows"],
        "training_time_seconds": seconds,
    }
    return FittedForecaster(model, features, metrics)


def forecaster_metrics(fitted: FittedForecaster, like: DataFrame) -> DataFrame:
    """The scores of a fitted model as (metric, value) rows."""
    rows = [(k, None if v is None else float(v)) for k, v in fitted.metrics.items()]
    return like.sparkSession.createDataFrame(rows, "metric string, value double")


def feature_importance(model: PipelineModel, features: list[str], like: DataFrame) -> DataFrame:
    """Feature and importance, most important first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return like.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def forecast_requests(
    pairs: DataFrame,
    items: DataFrame,
    as_of: dt.date,
    days: int = 7,
    top_items: int | None = None,
    max_places: int | None = None,
) -> DataFrame:
    """(item, place, date) for every (item_id, place_id) seen in ``pairs`` and the days after ``as_of``.

    All pairs by default. ``top_items`` keeps the items of ``items`` with the largest quantity, ``max_places`` the first
    places by id; both are optional limits of the caller.
    """
    chosen = pairs.select("item_id", "place_id").where("item_id IS NOT NULL AND place_id IS NOT NULL").distinct()
    if top_items is not None:
        top = items.orderBy(F.desc("total_qty"), "item_id").limit(top_items).select("item_id")
        chosen = chosen.join(top, "item_id", "left_semi")
    if max_places is not None:
        first = chosen.select("place_id").distinct().orderBy("place_id").limit(max_places)
        chosen = chosen.join(first, "place_id", "left_semi")
    first_day = F.lit(as_of + dt.timedelta(days=1)).cast("date")
    last_day = F.lit(as_of + dt.timedelta(days=days)).cast("date")
    return chosen.select("item_id", "place_id", F.explode(F.sequence(first_day, last_day)).alias("date"))


def request_features(requests: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """Features of (item_id, place_id, date) requests; both lags stand at the item mean.

    Requests for an unknown item or place are dropped.
    """
    known = requests.join(items.select("item_id", "avg_price", "avg_daily_qty", "std_daily_qty"), "item_id").join(
        places.select("place_id", F.col("total_orders").alias("total_orders_restaurant"), "avg_order_value"), "place_id"
    )
    return known.withColumns(
        {
            **calendar_fields(F.col("date")),
            "lag_7d_avg": F.col("avg_daily_qty"),
            "lag_14d_avg": F.col("avg_daily_qty"),
        }
    )


def predict_demand(fitted: FittedForecaster, requests: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """Predicted demand per request, not below 0, rounded to one decimal."""
    known = request_features(requests, items, places)
    filled = known.fillna(0.0, subset=[c for c in fitted.features if c in known.columns])
    return fitted.model.transform(filled).select(
        "date",
        "item_id",
        "place_id",
        F.bround(F.greatest(F.col("prediction"), F.lit(0.0)), 1).alias("predicted_demand"),
    )


def forecast_all(
    fitted: FittedForecaster,
    pairs: DataFrame,
    items: DataFrame,
    places: DataFrame,
    as_of: dt.date,
    days: int = 7,
    top_items: int | None = None,
    max_places: int | None = None,
) -> DataFrame:
    """Predictions for all requests in one job; every observed (item, place) pair unless the caller limits them."""
    asked = forecast_requests(pairs, items, as_of, days, top_items, max_places)
    return predict_demand(fitted, asked, items, places)


def training_summary(demand: DataFrame) -> DataFrame:
    """Records, distinct items and places, first and last date."""
    return demand.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("item_id").alias("unique_items"),
        F.countDistinct("place_id").alias("unique_restaurants"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def forecast_band(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast as one series, the forecast with a band of 20 % to either side."""
    past = history.select(
        "item_id",
        "place_id",
        "date",
        F.lit("history").alias("kind"),
        F.col("quantity_demanded").alias("demand"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )
    ahead = forecast.select(
        "item_id",
        "place_id",
        "date",
        F.lit("forecast").alias("kind"),
        F.col("predicted_demand").alias("demand"),
        (F.col("predicted_demand") * 0.8).alias("low"),
        (F.col("predicted_demand") * 1.2).alias("high"),
    )
    return past.unionByName(ahead)
