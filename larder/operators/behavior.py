"""When, what and how much is ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.functions import labels as L
from larder.functions.calendar import order_calendar
from larder.functions.ranks import exact_percentiles
from larder.functions.scalars import attach, lookup
from larder.session import written


def line_totals(order_items: DataFrame) -> DataFrame:
    """Lines, quantity and price sum per order: combined on the map side before anything is shuffled."""
    return (
        order_items.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
            F.coalesce(F.sum("price"), F.lit(0.0)).alias("price_sum"),
        )
    )


def order_facts(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders that have lines, with their calendar and line totals.

    Line totals are already partitioned on the order id, so the join and a later distinct count of orders need no
    further shuffle of the lines.
    """
    head = order_calendar(orders).select(
        F.col("id").alias("order_id"),
        "place_id",
        "order_date",
        "hour",
        "day_of_week",
        "day_name",
        "month",
        "is_weekend",
    )
    return line_totals(order_items).join(head, "order_id")


def hourly_pattern(facts: DataFrame) -> DataFrame:
    """Orders, quantity and price sum per hour."""
    return (
        facts.where("hour IS NOT NULL")
        .groupBy("hour")
        .agg(
            F.countDistinct("order_id").alias("num_orders"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("price_sum").alias("total_revenue"),
        )
        .orderBy("hour")
    )


def weekday_pattern(facts: DataFrame) -> DataFrame:
    """Orders and quantity per day name, Monday first."""
    return (
        facts.where("day_name IS NOT NULL")
        .groupBy("day_of_week", "day_name")
        .agg(F.countDistinct("order_id").alias("num_orders"), F.sum("quantity").alias("total_quantity"))
        .orderBy("day_of_week")
        .select("day_name", "num_orders", "total_quantity")
    )


def monthly_pattern(facts: DataFrame) -> DataFrame:
    """Orders and quantity per month number."""
    return (
        facts.where("month IS NOT NULL")
        .groupBy("month")
        .agg(F.countDistinct("order_id").alias("num_orders"), F.sum("quantity").alias("total_quantity"))
        .orderBy("month")
    )


def temporal_insights(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: busiest hour and day, percent of weekend orders, orders per day that had any.

    Ties go to the earliest hour and to the earliest day of the week. The orders with their calendar are written once, so
    that the lines are read a single time for all figures.
    """
    rank = lookup("day_name", {d: i for i, d in enumerate(L.DAY_NAMES)})
    seen = written(facts.select("order_id", "order_date", "hour", "day_name", "is_weekend").distinct(), "seen")
    per = lambda *keys: seen.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.countDistinct("order_id").alias("n"))
    hour = per("hour").agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak"))
    day = per("day_name").agg(F.max_by("day_name", F.struct(F.col("n"), -rank)).alias("peak"))
    kinds = seen.where("order_date IS NOT NULL").groupBy("is_weekend").agg(F.countDistinct("order_id").alias("n"))
    split = kinds.agg(F.sum(F.when(F.col("is_weekend") == 1, F.col("n")).otherwise(0)).alias("weekend"), F.sum("n").alias("all"))
    rate = order_calendar(orders).agg(
        F.countDistinct("order_date").alias("days"), F.countDistinct("id").cast("double").alias("orders")
    )
    return attach(split, hour=hour, day=day, rate=rate).select(
        F.col("hour.peak").alias("peak_hour"),
        F.format_string("%02d:00", "hour.peak").alias("peak_hour_label"),
        F.col("day.peak").alias("peak_day"),
        F.bround(F.try_divide(F.col("weekend") * 100.0, F.col("all")), 1).alias("weekend_pct"),
        F.bround(F.try_divide("rate.orders", "rate.days"), 1).alias("avg_orders_per_day"),
    )


def basket_stats(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: mean distinct items, mean quantity, mean and median value of orders that have lines.

    The orders with their basket sizes are written to the shared folder, as the median reads them more than once.
    """
    baskets = (
        order_items.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.countDistinct("item_id").alias("unique_items"),
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
        )
    )
    amounts = orders.where("id IS NOT NULL").groupBy(F.col("id").alias("order_id")).agg(
        F.any_value("total_amount", True).alias("total_amount")
    )
    joined = written(baskets.join(amounts, "order_id").drop("order_id"), "baskets")
    median = exact_percentiles(joined, {"m": ("total_amount", 0.5)}).scalar()
    return joined.agg(
        F.bround(F.avg("unique_items"), 1).alias("avg_items_per_order"),
        F.bround(F.avg("quantity"), 1).alias("avg_quantity_per_order"),
        F.bround(F.avg("total_amount"), 2).alias("avg_order_value"),
    ).withColumn("median_order_value", F.bround(median, 2))


def top_items(order_items: DataFrame, n: int = 20) -> DataFrame:
    """Quantity, orders and mean price of the n most ordered items."""
    return (
        order_items.where(F.col("item_id").isNotNull())
        .groupBy("item_id")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_qty"),
            F.countDistinct("order_id").alias("num_orders"),
            F.avg("price").alias("avg_price"),
        )
        .orderBy(F.desc("total_qty"), "item_id")
        .limit(n)
    )


def order_type_counts(orders: DataFrame) -> DataFrame:
    return (
        orders.where("type IS NOT NULL")
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "type")
    )


def co_purchased_items(
    order_items: DataFrame, min_support: float = 0.01, top_n: int = 50, slice_items: int = 1_000
) -> DataFrame:
    """Pairs of items ordered together: count, support and lift, the n most frequent.

    A pair reaches the support only if each of its items does, so items below it are dropped before any pair is
    built. What is left per order is bounded by (mean basket size / min_support) items. Baskets larger than
    ``slice_items`` are cut into slices on one side and repeated per slice on the other, so that the pairs of one
    huge basket are built by many tasks. The lines are read once: the distinct items of each order are written when called, and
    the number of orders and of each item's orders come from that table.
    """
    known = order_items.where("order_id IS NOT NULL").select("order_id", "item_id").distinct()
    known = written(known, "baskets")
    ordered = known.where("item_id IS NOT NULL")
    total = F.lit(float(known.agg(F.countDistinct("order_id")).first()[0] or 1))
    frequency = ordered.groupBy("item_id").agg(F.count(F.lit(1)).alias("orders"))
    frequent = written(frequency.where(F.col("orders") / total >= min_support), "frequent")
    kept = ordered.join(frequent, "item_id", "left_semi")
    sizes = kept.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / slice_items).cast("int").alias("slices"))
    baskets = kept.join(sizes, "order_id")
    left = baskets.select(
        "order_id", F.pmod(F.xxhash64("item_id"), "slices").cast("int").alias("slice"), F.col("item_id").alias("item_1")
    )
    right = baskets.select(
        "order_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("item_id").alias("item_2")
    )
    counts = (
        left.join(right, ["order_id", "slice"])
        .where(F.col("item_1") < F.col("item_2"))
        .groupBy("item_1", "item_2")
        .agg(F.count(F.lit(1)).alias("co_purchase_count"))
        .withColumn("support", F.col("co_purchase_count") / total)
        .where(F.col("support") >= min_support)
        .orderBy(F.desc("co_purchase_count"), "item_1", "item_2")
        .limit(top_n)
    )
    share = frequent.select("item_id", (F.col("orders") / total).alias("share"))
    return (
        counts.join(share.toDF("item_1", "f1"), "item_1")
        .join(share.toDF("item_2", "f2"), "item_2")
        .select(
            "item_1",
            "item_2",
            "co_purchase_count",
            "support",
            (F.col("support") / (F.col("f1") * F.col("f2"))).alias("lift"),
        )
        .orderBy(F.desc("co_purchase_count"), "item_1", "item_2")
    )


def restaurant_performance(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per place: orders, quantity, price sum, distinct items, commonest hour of a line, and ratios; busiest first.

    The lines are read once: they are combined per order and item before any shuffle, joined to their orders and written;
    all figures come from that table, each at its own grain, and meet as one row per place.
    """
    sold = (
        order_items.where("order_id IS NOT NULL")
        .groupBy("order_id", "item_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
            F.coalesce(F.sum("price"), F.lit(0.0)).alias("price_sum"),
        )
    )
    head = order_calendar(orders).where("place_id IS NOT NULL").select(F.col("id").alias("order_id"), "place_id", "hour")
    facts = written(sold.join(head, "order_id"), "sold")
    totals = facts.groupBy("place_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("price_sum").alias("total_revenue"),
    )
    hours = facts.where("hour IS NOT NULL").groupBy("place_id", "hour").agg(F.sum("lines").alias("lines"))
    peak = hours.groupBy("place_id").agg(
        F.max_by("hour", F.struct(F.col("lines"), -F.col("hour"))).alias("peak_hour")
    )
    variety = facts.where("item_id IS NOT NULL").groupBy("place_id").agg(F.countDistinct("item_id").alias("unique_items_sold"))
    return (
        totals.join(variety, "place_id", "left")
        .join(peak, "place_id", "left")
        .select(
            "place_id",
            "total_orders",
            "total_quantity",
            "total_revenue",
            F.coalesce("unique_items_sold", F.lit(0)).alias("unique_items_sold"),
            "peak_hour",
        )
        .withColumns(
            {
                "avg_order_value": F.bround(F.try_divide("total_revenue", "total_orders"), 2),
                "items_per_order": F.bround(F.try_divide("unique_items_sold", "total_orders"), 2),
            }
        )
        .orderBy(F.desc("total_orders"), "place_id")
    )


def behavior_coverage(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: orders, lines, distinct items, places that have orders with lines."""
    with_lines = orders.select("id", "place_id").join(
        order_items.select(F.col("order_id").alias("id")).distinct(), "id", "left_semi"
    )
    return order_items.agg(
        F.count(F.lit(1)).alias("total_order_items"), F.countDistinct("item_id").alias("unique_items")
    ).select(
        orders.agg(F.count(F.lit(1))).scalar().alias("total_orders"),
        "total_order_items",
        "unique_items",
        with_lines.agg(F.countDistinct("place_id")).scalar().alias("unique_restaurants"),
    )
