"""Tables stored so that the usual joins and filters need no shuffle and read little: bucketed by order, partitioned by month."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.functions.scalars import event_time


ROWS_PER_BUCKET = 400_000  # a bucket is sorted and joined by one task


def buckets_for(df: DataFrame, least: int = 8) -> int:
    """Buckets for a table of as many rows as ``df``: no more rows in each, on average, however large it is. Counts the rows."""
    return max(least, math.ceil(df.count() / ROWS_PER_BUCKET))


def store_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str, file_format: str = "parquet") -> DataFrame:
    """``df`` as a catalogue table with its rows dealt into ``buckets`` by ``key`` and sorted by it inside them.

    The rows are dealt by the same hash before they are written, so each bucket is one file, not one for every task. Two tables
    with the same key type and number of buckets join without an exchange.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.format(file_format).bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def store_partitioned(df: DataFrame, table: str, by: str, path: str, file_format: str = "parquet", rows_per_file: int = 5_000_000) -> DataFrame:
    """``df`` as a catalogue table with a folder per value of ``by``; a filter on it reads those folders alone.

    Rows of a value are brought together first, into as many tasks as their bytes call for, so that files do not multiply by tasks.
    """
    writer = df.hint("rebalance", F.col(by)).write.format(file_format).partitionBy(by).option("path", path).option("maxRecordsPerFile", rows_per_file)
    writer.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def store_orders(spark: SparkSession, orders: DataFrame, lines: DataFrame, prefix: str, folder: str, buckets: int = 64, file_format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(orders, lines) bucketed alike by order id, for joins on it."""
    heads = orders.withColumnRenamed("id", "order_id")
    return (
        store_bucketed(heads, f"{prefix}_orders", "order_id", buckets, f"{folder}/orders", file_format),
        store_bucketed(lines, f"{prefix}_lines", "order_id", buckets, f"{folder}/lines", file_format),
    )


def stored_order_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Order lines with place and time, from two tables that are bucketed by order id."""
    placed = event_time("created")
    return lines.join(orders.select("order_id", "place_id", placed.alias("placed"), F.to_date(placed).alias("order_date")), "order_id")


def store_daily_demand(lines: DataFrame, table: str, path: str, file_format: str = "parquet") -> DataFrame:
    """(item_id, place_id, date, quantity, orders) per month of ``date``, from stored order lines."""
    daily = lines.groupBy("item_id", "place_id", F.col("order_date").alias("date")).agg(
        F.sum("quantity").alias("quantity"), F.countDistinct("order_id").alias("orders")
    )
    return store_partitioned(daily.withColumn("month", F.date_format("date", "yyyy-MM")), table, "month", path, file_format)
