"""Orders while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.sources import schemas
from larder.sources.orders import split_orders
from larder.streaming.sinks import write_batch


def read_order_messages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Order messages as JSON lines from a folder; new files are picked up as they appear."""
    reader = spark.readStream.schema(schemas.ORDER_MESSAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def stream_orders(messages: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Split arriving messages into the orders and order_items tables, one folder per batch in each.

    A batch that is run again after a failure overwrites its own folders, so nothing is stored twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two outputs, one reading of the messages
        try:
            orders, lines = split_orders(batch, F.current_timestamp())
            write_batch(orders, f"{folder}/orders", batch_id)
            write_batch(lines, f"{folder}/order_items", batch_id)
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def hourly_orders(orders: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Orders and revenue per clock hour of a stream of (timestamp, total_amount); later rows are dropped."""
    return (
        orders.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 hour"))
        .agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("revenue"))
        .select(F.col("window.start").alias("hour_start"), F.col("window.end").alias("hour_end"), "orders", "revenue")
    )


def stream_to_table(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed windows to a Parquet table; Spark's file sink stores each row once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
