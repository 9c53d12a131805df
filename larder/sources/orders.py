"""Live orders: nested messages to order rows and line rows, and appends to the live tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from larder.functions.scalars import require_columns
from larder.sources import schemas


def split_orders(messages: DataFrame, received: Column) -> tuple[DataFrame, DataFrame]:
    """Order rows and one row per item, both keyed by the message's own order_id.

    The id comes with the message, so a replayed batch produces the same rows. A message without items still
    gives its order row.
    """
    require_columns(messages, ["order_id", "restaurant_id", "total_amount", "items"], "order messages")
    orders = messages.select(
        F.col("order_id").cast("string").alias("id"),
        "restaurant_id",
        received.cast("timestamp").alias("timestamp"),
        "total_amount",
    )
    lines = messages.select(
        F.col("order_id").cast("string").alias("order_id"), F.posexplode("items").alias("line_no", "item")
    ).select(
        "order_id",
        "line_no",
        F.col("item.menu_item_id").alias("menu_item_id"),
        F.col("item.quantity").alias("quantity"),
        F.col("item.price").alias("price_at_time"),
    )
    return orders, lines


def append_rows(df: DataFrame, folder: str, name: str, schema: T.StructType) -> None:
    """Append rows to a live table after casting them to its schema; missing required columns raise."""
    require_columns(df, [f.name for f in schema.fields], name)
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("append").parquet(
        f"{folder.rstrip('/')}/{name}"
    )


def append_orders(messages: DataFrame, folder: str, received: Column | None = None) -> None:
    """Split order messages and append both parts."""
    orders, lines = split_orders(messages, F.current_timestamp() if received is None else received)
    append_rows(orders, folder, "orders", schemas.LIVE_ORDERS)
    append_rows(lines, folder, "order_items", schemas.LIVE_ORDER_ITEMS)


def append_restaurants(rows: DataFrame, folder: str) -> None:
    append_rows(rows, folder, "restaurants", schemas.RESTAURANTS)


def append_menu_items(rows: DataFrame, folder: str) -> None:
    """Append menu items; the description may be left out."""
    if "description" not in rows.columns:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    append_rows(rows, folder, "menu_items", schemas.LIVE_MENU_ITEMS)
