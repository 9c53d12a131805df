"""Demand per local day of each place, and averages over days instead of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larder.functions.scalars import event_time


def local_demand(lines: DataFrame, orders: DataFrame, places: DataFrame, zone: str = "zone") -> DataFrame:
    """(place_id, day, quantity, orders): demand per day as the clocks of each place tell it.

    ``places`` has id and a time zone's name; a place without one counts in UTC. A day has 23 or 25 hours where the clocks change.
    Lines are summed per order before they meet the orders, so only one row per order is shuffled twice.
    """
    of_order = lines.groupBy("order_id").agg(F.sum("quantity").alias("quantity"))
    zones = places.select(F.col("id").alias("place_id"), F.coalesce(F.col(zone), F.lit("UTC")).alias("zone"))
    utc = F.to_timestamp_ntz(F.date_format(event_time("created"), "yyyy-MM-dd HH:mm:ss"))
    placed = orders.select(F.col("id").alias("order_id"), "place_id", utc.alias("utc")).join(zones, "place_id", "left")
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.coalesce("zone", F.lit("UTC")), F.col("utc")))
    return (
        placed.select("order_id", "place_id", day.alias("day"))
        .join(of_order, "order_id")
        .groupBy("place_id", "day")
        .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("orders"))
    )


def every_day(daily: DataFrame, key: str = "place_id", day: str = "day", zeros: tuple[str, ...] = ("quantity", "orders")) -> DataFrame:
    """``daily`` with a row for each day between a key's first and last, the missing ones with 0 in ``zeros``."""
    span = daily.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    calendar = span.select(key, F.explode(F.sequence("first", "last")).alias(day))
    filled = calendar.join(daily, [key, day], "left")
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def averages_by_days(daily: DataFrame, days: tuple[int, ...] = (7, 14), key: str = "place_id", value: str = "quantity") -> DataFrame:
    """Averages of ``value`` over the 7 (14) days before each row's day, counting days and not rows; null without any."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    numbered = daily.withColumn("_n", number)
    made = {
        f"{value}_{n}d": F.avg(value).over(Window.partitionBy(key).orderBy("_n").rangeBetween(-n, -1)) for n in days
    }
    return numbered.withColumns(made).drop("_n")
