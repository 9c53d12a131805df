"""Revenue and orders by place, category and month, with all totals from one pass over the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larder.functions.scalars import event_time

KEYS = ("place_id", "category", "month")


def sales_cells(lines: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """(place_id, category, month, revenue, quantity, orders, first_orders): the finest cells that all totals add up from.

    An order lies in one place and month, but may lie in several categories. ``orders`` counts it in each of its categories,
    ``first_orders`` in the first only, so that totals over categories are sums, too, and no distinct count is left.
    """
    category = items.select(F.col("id").alias("item_id"), F.col("category"))
    of_order = (
        lines.select("order_id", "item_id", "quantity", "total_cost")
        .join(category, "item_id", "left")
        .groupBy("order_id", "category")
        .agg(F.sum("total_cost").alias("revenue"), F.sum("quantity").alias("quantity"))
    )
    first = F.when(F.row_number().over(Window.partitionBy("order_id").orderBy("category")) == 1, 1).otherwise(0)
    month = F.trunc(F.to_date(event_time("created")), "month")
    placed = orders.select(F.col("id").alias("order_id"), "place_id", month.alias("month"))
    return (
        of_order.withColumn("first", first)
        .join(placed, "order_id")
        .groupBy(*KEYS)
        .agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("orders"), F.sum("first").alias("first_orders"))
    )


def _totals(grouped) -> DataFrame:
    return grouped.agg(
        *[F.grouping(k).cast("int").alias(f"all_{k}") for k in KEYS],
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.when(F.grouping("category") == 1, F.sum("first_orders")).otherwise(F.sum("orders")).alias("orders"),
    )


def sales_cube(cells: DataFrame) -> DataFrame:
    """Every combination of keys and totals: keys, all_<key> (1: a total over that key, whose null is no value), revenue, quantity,
    orders (distinct)."""
    return _totals(cells.cube(*KEYS))


def sales_rollup(cells: DataFrame) -> DataFrame:
    """Place, then category, then month, each with the total of what follows it."""
    return _totals(cells.rollup(*KEYS))


def sales_sets(cells: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Chosen combinations only, for example [("place_id", "month"), ("category",), ()]."""
    return _totals(cells.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in KEYS]))
