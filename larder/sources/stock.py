"""Stock files: checking, parsing and mapping to inventory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.functions.scalars import number, require_columns
from larder.sources import schemas
from larder.sources.orders import append_rows


def read_stock_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Stock CSV with every column as text; parsing and rejecting is left to ``parse_stock``."""
    return spark.read.options(header=True, encoding=encoding, inferSchema=False).csv(path)


def parse_stock(raw: DataFrame, stamped: Column) -> tuple[DataFrame, DataFrame]:
    """Valid reports and rejected raw rows.

    Header names are trimmed and lower-cased; item_id and current_stock must be there. A missing or empty reorder
    point or safety stock counts as 0, one that does not parse rejects its row. Fractional ids are truncated.
    """
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    require_columns(df, ["item_id", "current_stock"], "stock file")

    def level(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        text = F.col(name).cast("string")
        return F.when(text.isNull() | (F.trim(text) == ""), F.lit(0.0)).otherwise(number(F.trim(text)))

    parsed = df.withColumns(
        {
            "_id": number(F.trim(F.col("item_id").cast("string"))).try_cast("bigint"),
            "_stock": number(F.trim(F.col("current_stock").cast("string"))),
            "_reorder": level("reorder_point"),
            "_safety": level("safety_stock"),
        }
    )
    good = (
        F.col("_id").isNotNull()
        & F.col("_stock").isNotNull()
        & F.col("_reorder").isNotNull()
        & F.col("_safety").isNotNull()
    )
    valid = parsed.where(good).select(
        stamped.cast("timestamp").alias("date"),
        F.col("_id").alias("item_id"),
        F.col("_stock").alias("current_stock"),
        F.col("_reorder").alias("reorder_point"),
        F.col("_safety").alias("safety_stock"),
    )
    rejected = parsed.where(~good).drop("_id", "_stock", "_reorder", "_safety")
    return valid, rejected


def ingest_inventory(
    spark: SparkSession, path: str, folder: str, stamped: Column | None = None, encoding: str | None = None
) -> int:
    """Append the valid rows of a stock file to the inventory reports; returns their number, none at all raises.

    Without ``encoding`` a file that holds bytes which are no UTF-8 is read as Latin-1.
    """
    stamp = F.current_timestamp() if stamped is None else stamped
    raw = read_stock_csv(spark, path, encoding or "UTF-8")
    if encoding is None and not raw.where(F.concat_ws("", *[F.col(f"`{c}`") for c in raw.columns]).contains("\ufffd")).isEmpty():
        raw = read_stock_csv(spark, path, "ISO-8859-1")
    valid, _ = parse_stock(raw, stamp)
    valid = valid.persist()
    try:
        count = valid.count()
        if count == 0:
            raise ValueError("no valid rows in the stock file")
        append_rows(valid, folder, "inventory_reports", schemas.INVENTORY_REPORT)
    finally:
        valid.unpersist()
    return count


def sku_to_inventory(skus: DataFrame) -> DataFrame:
    """SKU list to stock rows: quantity is the stock, the low-stock threshold the reorder point, half of it safety."""
    item = number(F.trim(F.col("item_id").cast("string"))).try_cast("bigint")
    reorder = F.col("low_stock_threshold").cast("double")
    return skus.select(
        item.alias("item_id"),
        F.col("quantity").cast("double").alias("current_stock"),
        reorder.alias("reorder_point"),
        (reorder * 0.5).alias("safety_stock"),
    ).where(F.col("item_id").isNotNull())
