"""Streams run to the end of their input; SQL checks the state they end in."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators.inventory import upload_status
from larder.registry.base import query, r, rounded
from larder.registry.inventory import UPLOAD_SQL
from larder.session import scratch_path
from larder.sources import schemas
from larder.streaming import orders, sessions, sinks, stock


def event_stream(t):
    """The events file as a stream."""
    schema = t.raw("events").schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def report_stream(t, folder):
    """The inventory reports as three uploads, one per copy, read one file a batch in the order of their writing."""
    for copy in (1, 2, 3):
        part = t.inventory_reports.where(F.col("id") % 10 == copy)
        part.coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(t.inventory_reports.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(
    "st1_stream_orders",
    f"SELECT order_id, line_no, menu_item_id, quantity, {r('price_at_time', 4)} FROM live_order_items",
)
def st1(t):
    base = scratch_path(t.spark, "orders")
    t.order_messages.drop("sent").write.json(f"{base}/in")
    messages = orders.read_order_messages(t.spark, f"{base}/in", files_per_batch=4)
    orders.stream_orders(messages, f"{base}/out", f"{base}/state").awaitTermination()
    rows = sinks.read_batches(t.spark, f"{base}/out/order_items", schemas.LIVE_ORDER_ITEMS)
    return rounded(rows.drop("batch_id"), price_at_time=4)


@query(
    "st2_stream_inventory",
    """SELECT TRY_CAST(item_id AS BIGINT) AS item_id, quantity AS current_stock, low_stock_threshold AS reorder_point,
              0.0::DOUBLE AS safety_stock FROM dim_skus WHERE TRY_CAST(item_id AS BIGINT) IS NOT NULL""",
)
def st2(t):
    base = scratch_path(t.spark, "stock")
    columns = ["Item_ID", "Current_Stock", "Reorder_Point"]
    t.skus.toDF(*columns).write.option("header", True).csv(f"{base}/in")
    raw = stock.read_stock_files(t.spark, f"{base}/in", columns, files_per_batch=None)
    stock.stream_inventory(raw, f"{base}/out", f"{base}/state").awaitTermination()
    rows = sinks.read_batches(t.spark, f"{base}/out/inventory_reports", schemas.INVENTORY_REPORT)
    return rows.drop("batch_id", "date")


@query("st3_stream_latest_stock", "SELECT item_id, id, date, current_stock, reorder_point, safety_stock FROM latest_reports")
def st3(t):
    base = scratch_path(t.spark, "latest")
    reports = report_stream(t, f"{base}/in")
    stock.stream_latest_stock(reports, f"{base}/out", f"{base}/state").awaitTermination()
    rows = sinks.newest_per_key(sinks.read_batches(t.spark, f"{base}/out", t.inventory_reports.schema), "item_id")
    return rows.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    "st4_stream_alerts",
    UPLOAD_SQL
    + " FROM (SELECT item_id, current_stock, reorder_point, safety_stock FROM inventory_reports WHERE id % 10 = 3)"
    + " LEFT JOIN dim_items d ON item_id = d.id",
)
def st4(t):
    base = scratch_path(t.spark, "alerts")
    reports = report_stream(t, f"{base}/in")
    stock.stream_alerts(reports, t.items, f"{base}/out", f"{base}/state").awaitTermination()
    schema = upload_status(t.inventory_reports, t.items).schema
    return sinks.newest_batch(sinks.read_batches(t.spark, f"{base}/out", schema))


@query(
    "st5_stream_hourly_orders",
    f"""SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end,
               count(*) AS orders, {r('sum(value)', 2, 'revenue')}
        FROM events WHERE event_type = 'purchase'
        GROUP BY 1, 2
        HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
               <= (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 HOUR""",
)
def st5(t):
    base = scratch_path(t.spark, "hourly")
    arriving = (
        event_stream(t)
        .where("event_type = 'purchase'")
        .select(F.col("ts").alias("timestamp"), F.col("value").alias("total_amount"))
    )
    hourly = orders.hourly_orders(arriving)
    orders.stream_to_table(hourly, f"{base}/out", f"{base}/state").awaitTermination()
    rows = t.spark.read.schema(hourly.schema).parquet(f"{base}/out")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("hour_start", "hour_end")}
    return rounded(rows.withColumns(times), revenue=2)


SESSIONS_SQL = """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR
                                        THEN 0 ELSE 1 END AS fresh FROM events),
         n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, count(*) AS message_count, min(ts) AS created_at, max(ts) AS last_activity FROM n GROUP BY user_id, s"""


@query("st6_sessions", SESSIONS_SQL)
def st6(t):
    df = sessions.sessions(t.events)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_activity")})


@query(
    "st6_stream_sessions",
    SESSIONS_SQL + " HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def st6_stream(t):
    base = scratch_path(t.spark, "sessions")
    closed = sessions.sessions(event_stream(t))
    orders.stream_to_table(closed, f"{base}/out", f"{base}/state").awaitTermination()
    rows = t.spark.read.schema(closed.schema).parquet(f"{base}/out")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_activity")})
