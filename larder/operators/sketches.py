"""Approximate aggregates that can be stored per day and merged for any period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Relative standard error of distinct counts with 2**12 registers, and the rank error of quantiles with k = 200, both at
#: about 99 % confidence.
DISTINCT_ERROR = 3 * 1.04 / 2**6
RANK_ERROR = 0.0165


def daily_sketches(orders: DataFrame, lines: DataFrame, most_items: int = 10_000) -> DataFrame:
    """(day, customers, totals, items): a distinct sketch, a quantile sketch and a heavy-hitter sketch of each day.

    ``orders``: day, customer, total; ``lines``: day, item. The columns are plain binary values and may be written to Parquet. A day
    with orders but without lines has no items.
    """
    of_orders = orders.groupBy("day").agg(
        F.hll_sketch_agg("customer", 12).alias("customers"), F.kll_sketch_agg_double("total", 200).alias("totals")
    )
    of_lines = lines.groupBy("day").agg(F.expr(f"approx_top_k_accumulate(item, {most_items})").alias("items"))
    return of_orders.join(of_lines, "day", "left")


def merged(daily: DataFrame, period, most_items: int = 10_000) -> DataFrame:
    """(period, customers, totals, items): the days' sketches merged, without going back to the orders. A period without lines has
    no items."""
    dated = daily.withColumn("period", period)
    whole = dated.groupBy("period").agg(F.hll_union_agg("customers").alias("customers"), F.kll_merge_agg_double("totals").alias("totals"))
    sold = dated.where("items IS NOT NULL").groupBy("period").agg(F.expr(f"approx_top_k_combine(items, {most_items})").alias("items"))
    return whole.join(sold.withColumnRenamed("period", "_period"), F.col("period").eqNullSafe(F.col("_period")), "left").drop("_period")


def estimates(sketches: DataFrame, top: int = 10, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """What merged sketches say: distinct customers, quantiles of order totals (array), top items with counts (array)."""
    return sketches.select(
        "period",
        F.hll_sketch_estimate("customers").alias("distinct_customers"),
        F.array(*[F.kll_sketch_get_quantile_double("totals", F.lit(q)) for q in quantiles]).alias("quantiles"),
        F.expr(f"CASE WHEN items IS NOT NULL THEN approx_top_k_estimate(items, {top}) END").alias("top_items"),
    )
