"""Headline figures for the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.calendar import order_calendar
from larder.functions.ranks import exact_percentiles
from larder.functions.scalars import attach, event_time, hour_label, number
from larder.operators.behavior import line_totals


def dashboard_hourly(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Per hour of the day: label, orders, quantity of their lines, and revenue, both in whole units."""
    timed = order_calendar(orders).where("hour IS NOT NULL")
    per_hour = timed.groupBy("hour").agg(
        F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum(number("total_amount")), F.lit(0.0)).alias("revenue")
    )
    quantity = (
        line_totals(order_items)
        .join(timed.select(F.col("id").alias("order_id"), "hour"), "order_id")
        .groupBy("hour")
        .agg(F.sum("quantity").alias("quantity"))
    )
    return (
        per_hour.join(quantity, "hour", "left")
        .orderBy("hour")
        .select(
            hour_label("hour").alias("hour"),
            "orders",
            F.coalesce(F.col("quantity").cast("bigint"), F.lit(0)).alias("quantity"),
            F.col("revenue").cast("bigint").alias("revenue"),
        )
    )


def _mean_value() -> Column:
    return F.bround(F.avg(number("total_amount")), 2).alias("avg_order_value")


def _median_value(orders: DataFrame) -> Column:
    return F.bround(exact_percentiles(orders, {"m": ("total_amount", 0.5)}).scalar(), 2).alias("median_order_value")


def _per_day() -> Column:
    at = event_time("created")
    seconds = F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))
    days = F.greatest(F.floor(seconds / 86400), F.lit(1))
    return F.bround(F.count(F.lit(1)) / days, 1).alias("avg_orders_per_day")


def _peaks() -> list[Column]:
    """Over orders with their calendar; orders without a time count for none of them."""
    return [
        F.mode("hour", True).alias("peak_hour"),
        F.mode("day_name", True).alias("peak_day"),
        F.bround(F.avg(F.col("is_weekend").cast("double")) * 100, 1).alias("weekend_pct"),
    ]


def _hour_of_peak() -> Column:
    return F.format_string("%d:00", "peak_hour").alias("peak_hour_label")


def order_value_stats(orders: DataFrame) -> DataFrame:
    """One row: mean and median order total, rounded to 2."""
    return orders.agg(_mean_value()).select("avg_order_value", _median_value(orders))


def lines_per_order(order_items: DataFrame) -> DataFrame:
    """One row: mean lines and mean quantity per order."""
    return line_totals(order_items).agg(
        F.bround(F.avg("lines"), 2).alias("avg_items_per_order"),
        F.bround(F.avg("quantity"), 2).alias("avg_quantity_per_order"),
    )


def orders_per_day(orders: DataFrame) -> DataFrame:
    """One row: orders over the whole days between the first and the last one, at least one day."""
    return orders.agg(_per_day())


def peak_by_mode(orders: DataFrame) -> DataFrame:
    """One row: commonest hour and day name of orders (lowest on ties), percent of weekend orders."""
    return order_calendar(orders).agg(*_peaks()).select("peak_hour", _hour_of_peak(), "peak_day", "weekend_pct")


def dashboard_summary(
    orders: DataFrame,
    order_items: DataFrame,
    dim_items: DataFrame,
    alert_counts: DataFrame,
    model_metrics: DataFrame | None = None,
) -> DataFrame:
    """One row with all headline figures; model scores only when there are any.

    The orders are read once for all figures but the median, which needs passes of its own: one when called, one or more in the plan.
    """
    totals = order_calendar(orders).agg(
        F.count(F.lit(1)).alias("total_orders"), F.countDistinct("place_id").alias("restaurants"), *_peaks(), _per_day(), _mean_value()
    )
    # One pass over the lines: their number is the sum of the lines per order.
    per_order = order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"))
    known = F.col("order_id").isNotNull()
    lines = per_order.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_order_items"),
        F.bround(F.avg(F.when(known, F.col("lines"))), 2).alias("avg_items_per_order"),
        F.bround(F.avg(F.when(known, F.col("quantity"))), 2).alias("avg_quantity_per_order"),
    )
    parts = {
        "menu": dim_items.agg(F.count(F.lit(1)).alias("menu_items")),
        "lines": lines,
        "alerts": alert_counts,
    }
    columns = ["total_orders", "lines.total_order_items", "restaurants", "menu.menu_items"]
    columns += ["peak_hour", _hour_of_peak(), "peak_day", "weekend_pct", "avg_orders_per_day"]
    columns += ["lines.avg_items_per_order", "lines.avg_quantity_per_order", "avg_order_value", _median_value(orders), "alerts.*"]
    if model_metrics is not None:
        parts["model"] = model_metrics
        columns += [F.col(f"model.{c}").alias(f"model_{c}") for c in ("r2", "mae", "rmse")]
    return attach(totals, **parts).select(*columns)


def _sizes(order_items: DataFrame, dim_items: DataFrame) -> DataFrame:
    return order_items.agg(F.count(F.lit(1)).alias("total_order_items")).withColumn(
        "menu_items", dim_items.agg(F.count(F.lit(1))).scalar()
    )


def inventory_summary(
    orders: DataFrame,
    order_items: DataFrame,
    dim_items: DataFrame,
    insights: DataFrame,
    baskets: DataFrame,
    alert_counts: DataFrame,
    model_metrics: DataFrame | None = None,
) -> DataFrame:
    """One nested record: data overview, order behaviour, baskets, model scores, stock alerts."""
    parts = {
        "customer_behavior": insights,
        "purchase_patterns": baskets,
        "inventory_alerts": alert_counts,
        **({"model_performance": model_metrics} if model_metrics is not None else {}),
    }
    totals = orders.agg(F.count(F.lit(1)).alias("total_orders"), F.countDistinct("place_id").alias("restaurants"))
    overview = attach(totals, sizes=_sizes(order_items, dim_items)).select(
        F.struct("total_orders", "sizes.total_order_items", "restaurants", "sizes.menu_items").alias("data_overview")
    )
    return attach(overview, **parts)
