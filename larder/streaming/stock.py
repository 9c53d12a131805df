"""Stock reports while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.inventory import latest_report, upload_status
from larder.sources.stock import parse_stock
from larder.streaming.sinks import write_batch


def read_stock_files(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int | None = 1) -> DataFrame:
    """Stock CSV files of a folder as text columns, by default one file, that is one upload, per batch."""
    reader = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def stream_inventory(raw: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parse arriving stock rows; valid ones go to inventory_reports, the others to rejected_stock."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two outputs, one reading of the files
        try:
            valid, rejected = parse_stock(batch, F.current_timestamp())
            write_batch(valid, f"{folder}/inventory_reports", batch_id)
            write_batch(rejected, f"{folder}/rejected_stock", batch_id)
        finally:
            batch.unpersist()

    return (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_latest_stock(reports: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest report per item as state; each batch stores the items it changed."""
    return (
        latest_report(reports)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_alerts(reports: DataFrame, dim_items: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Judge each upload by the upload rule; the alerts of the last batch are the ones in force."""
    return (
        reports.writeStream.foreachBatch(
            lambda batch, batch_id: write_batch(upload_status(batch, dim_items), path, batch_id)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
