"""Streams against the batch form of the same work."""

import json

import pytest
from pyspark.sql import functions as F

from larder.operators.conversations import expired_sessions, question_intent, token_usage, trim_history, visible_history
from larder.operators.inventory import latest_report, upload_status
from larder.sources import schemas
from larder.streaming import orders, sessions, sinks, stock


def drop_message(folder, name, order_id, items):
    message = {"order_id": order_id, "restaurant_id": 1, "total_amount": 9.0, "items": items}
    (folder / name).write_text(json.dumps(message) + "\n")


def test_orders_arrive_in_steps(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    item = {"menu_item_id": 5, "quantity": 2, "price": 4.5}
    drop_message(inbox, "a.json", "m1", [item, item])
    orders.stream_orders(orders.read_order_messages(spark, str(inbox)), out, state).awaitTermination()
    drop_message(inbox, "b.json", "m2", [item])
    orders.stream_orders(orders.read_order_messages(spark, str(inbox)), out, state).awaitTermination()
    lines = sinks.read_batches(spark, f"{out}/order_items", schemas.LIVE_ORDER_ITEMS)
    heads = sinks.read_batches(spark, f"{out}/orders", schemas.LIVE_ORDERS)
    assert sorted(r["id"] for r in heads.collect()) == ["m1", "m2"]
    assert lines.count() == 3 and heads.where("timestamp IS NULL").count() == 0


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_batch(spark.range(5), path, 0)
    sinks.write_batch(spark.range(5), path, 0)
    sinks.write_batch(spark.range(2), path, 1)
    rows = sinks.read_batches(spark, path, spark.range(1).schema)
    assert rows.count() == 7 and sinks.newest_batch(rows).count() == 2
    assert sinks.read_batches(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0


def test_stock_uploads(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("Item_ID,Current_Stock\n1,5\nx,5\n")
    raw = stock.read_stock_files(spark, str(inbox), ["Item_ID", "Current_Stock"])
    stock.stream_inventory(raw, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = sinks.read_batches(spark, str(tmp_path / "out" / "inventory_reports"), schemas.INVENTORY_REPORT)
    assert [(r["item_id"], r["current_stock"]) for r in rows.collect()] == [(1, 5.0)]
    rejected = spark.read.parquet(str(tmp_path / "out" / "rejected_stock"))
    assert [r["item_id"] for r in rejected.collect()] == ["x"]


def test_latest_stock_and_alerts_end_like_the_batch(spark, tables, tmp_path):
    reports = tables.inventory_reports
    inbox = str(tmp_path / "in")
    for copy in (2, 1, 3):  # the second upload is older than the first
        reports.where(F.col("id") % 10 == copy).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    stock.stream_latest_stock(stream, str(tmp_path / "s"), str(tmp_path / "c1")).awaitTermination()
    kept = sinks.newest_per_key(sinks.read_batches(spark, str(tmp_path / "s"), reports.schema), "item_id")
    assert sorted(map(tuple, kept.select(reports.columns).collect())) == sorted(
        map(tuple, latest_report(reports).select(reports.columns).collect())
    )
    stock.stream_alerts(stream, tables.items, str(tmp_path / "a"), str(tmp_path / "c2")).awaitTermination()
    want = upload_status(reports.where("id % 10 = 3"), tables.items)
    got = sinks.newest_batch(sinks.read_batches(spark, str(tmp_path / "a"), want.schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_orders_are_dropped(spark, tmp_path):
    inbox = str(tmp_path / "in")

    def arrive(*rows):
        df = spark.createDataFrame(rows, "timestamp string, total_amount double")
        df.withColumn("timestamp", F.to_timestamp("timestamp")).coalesce(1).write.mode("append").parquet(inbox)

    arrive(("2024-01-01 10:10:00", 5.0), ("2024-01-01 10:50:00", 7.0), ("2024-01-01 13:00:00", 1.0))
    hourly = lambda: orders.hourly_orders(
        spark.readStream.schema("timestamp timestamp, total_amount double").option("maxFilesPerTrigger", 1).parquet(inbox)
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    orders.stream_to_table(hourly(), out, state).awaitTermination()
    arrive(("2024-01-01 10:20:00", 100.0), ("2024-01-01 12:30:00", 2.0), ("2024-01-01 15:00:00", 1.0))
    orders.stream_to_table(hourly(), out, state).awaitTermination()
    rows = spark.read.schema(hourly().schema).parquet(out).orderBy("hour_start").collect()
    assert [(r["hour_start"].hour, r["orders"], r["revenue"]) for r in rows] == [(10, 2, 12.0), (12, 1, 2.0), (13, 1, 1.0)]


def test_sessions_split_at_the_gap(spark):
    log = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 03:59:59"), (1, "2024-01-01 08:00:00"), (2, "2024-01-01 00:00:00")],
        "user_id int, ts string",
    ).withColumn("ts", F.to_timestamp("ts"))
    rows = sessions.sessions(log).orderBy("user_id", "created_at").collect()
    assert [(r["user_id"], r["message_count"]) for r in rows] == [(1, 2), (1, 1), (2, 1)]


def test_expiry(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01")], "user_id int, ts string")
    log = log.withColumn("ts", F.to_timestamp("ts"))
    rows = expired_sessions(log, F.to_timestamp(F.lit("2024-01-01 04:00:01"))).collect()
    assert [r["user_id"] for r in rows] == [1]


def brute_trim(turns, limit):
    if len(turns) <= limit:
        return turns
    if turns[0][2] == "system":
        return [turns[0]] + turns[-(limit - 1) :]
    return turns[-limit:]


@pytest.mark.parametrize("limit", [2, 3, 5, 50])
def test_trim(spark, limit):
    turns = [(1, 0, "system")] + [(1, i, "user") for i in range(1, 7)]
    turns += [(2, i, "user") for i in range(6)] + [(3, 0, "system"), (3, 1, "user")] + [(4, 0, "user"), (4, 1, "system"), (4, 2, "user")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string")
    expected = [t for c in (1, 2, 3, 4) for t in brute_trim([x for x in turns if x[0] == c], limit)]
    assert sorted(map(tuple, trim_history(df, limit).collect())) == sorted(expected)


def test_visible(spark):
    df = spark.createDataFrame([(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant")], "conv_id int, turn int, role string")
    assert visible_history(df).count() == 2 and visible_history(df, include_system=True).count() == 3
    assert visible_history(df.where("role = 'system'")).count() == 0


def test_intent_rules_in_order(spark):
    texts = ["Best way to grow?", "what to DROP", "more profit", "hello", "stop it", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r["intent"], r["confidence"]) for r in question_intent(df).collect()]
    assert got == [
        ("best_items", 0.85),
        ("items_to_remove", 0.82),
        ("grow_revenue", 0.78),
        ("general", 0.65),
        ("best_items", 0.85),
        ("general", 0.65),
    ]


def test_tokens(spark):
    calls = spark.createDataFrame([(10, 5), (None, 2)], "prompt_tokens long, completion_tokens long")
    assert tuple(token_usage(calls).first()) == (2, 10, 7, 17)
    assert tuple(token_usage(calls.limit(0)).first()) == (0, 0, 0, 0)


def test_newest_batch_opens_its_own_folder_only(spark, tmp_path):
    from larder.streaming.sinks import newest_batch, read_batches, write_batch

    for n in range(50):
        write_batch(spark.range(n, n + 3), str(tmp_path), n)
    newest = newest_batch(read_batches(spark, str(tmp_path), spark.range(1).schema))
    assert sorted(r["id"] for r in newest.collect()) == [49, 50, 51]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "batch_id" in plan.split("PartitionFilters")[1].split("]")[0]
