"""Current tables, joined streams, sketches, local days, open messages, SQL functions and stored tables."""

import json
import random
import uuid
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.functions.sql import register_functions
from larder.operators import local_days, sketches
from larder.registry import extended
from larder.sources import messages, stored
from larder.streaming.current import CurrentTable
from larder.streaming.order_join import join_heads_and_lines
from larder.streaming.orders import stream_to_table

ROW = "item_id long, at int, stock double"


def test_a_read_opens_a_bounded_number_of_parts(spark, tmp_path):
    """Fifty batches against a dictionary; a batch that comes twice changes nothing."""
    draw, want = random.Random(1), {}
    table = CurrentTable(spark, str(tmp_path / "t"), "item_id", ["at"], most_parts=3)
    with pytest.raises(ValueError):
        table.read()
    for batch in range(50):
        rows = [(draw.choice([None, *range(8)]), draw.randrange(60), float(batch)) for _ in range(draw.randrange(5))]
        for item, at, stock in rows:
            if item is not None and (item not in want or (at, stock) >= want[item]):
                want[item] = (at, stock)
        df = spark.createDataFrame(rows, ROW).coalesce(1)
        assert table.merge(df, batch) and not table.merge(spark.createDataFrame([(1, 999, 0.0)], ROW), batch)
        assert len(table.manifest()["parts"]) <= 4
    files = table.read().inputFiles()
    assert {f.split("/")[-2] for f in files} <= set(table.manifest()["parts"])
    assert {r.item_id: (r.at, r.stock) for r in table.read().collect()} == want
    assert table.manifest()["version"] == 50 and table.vacuum() > 0 and table.vacuum() == 0
    assert {r.item_id: (r.at, r.stock) for r in table.read().collect()} == want


def test_recovery_between_writing_and_committing(spark, tmp_path, monkeypatch):
    table = CurrentTable(spark, str(tmp_path / "t"), "item_id", ["at"])
    one, two = (spark.createDataFrame([(1, n, float(n))], ROW) for n in (1, 2))
    table.merge(one, 0)
    with monkeypatch.context() as broken:
        broken.setattr(CurrentTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(two, 1)
    again = CurrentTable(spark, str(tmp_path / "t"), "item_id", ["at"])
    assert again.read().first().at == 1 and again.merge(two, 1) and again.read().first().at == 2
    assert again.vacuum() == 1  # what the crash has left
    with pytest.raises(RuntimeError):
        again._commit({"version": 2, "batch_id": 9, "parts": []})
    assert again.read().first().at == 2


def _stream(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_heads_and_lines_that_arrive_apart(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    heads = [[(1, at(0), "a"), (2, at(5), "b")], [(3, at(200), "c")], [(4, at(210), "d")], [(9, at(5000), "end"), (5, at(1), "too late")]]
    lines = [[(1, 0, at(1)), (2, 0, at(400)), (7, 0, at(2))], [(3, 0, at(195)), (5, 0, at(3))], [(3, 1, at(185)), (1, 1, at(190))], [(99, 0, at(5000))]]
    a = _stream(spark, str(tmp_path / "h"), heads, "order_id long, placed timestamp, name string")
    b = _stream(spark, str(tmp_path / "l"), lines, "order_id long, line_no int, sent timestamp")
    query = stream_to_table(join_heads_and_lines(a, b), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    rows = {(r.order_id, r.line_no): r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 2: sent too long after; 5: its head came when it had been given up; 7: no head; (3, 1) too early.
    assert rows.pop((1, 1), None) is None
    assert {k: v for k, v in rows.items() if k[0] < 90} == {(1, 0): "a", (2, 0): None, (7, 0): None, (3, 0): "c", (5, 0): None, (3, 1): None}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # only what the last rows may still need


def test_sketches_merge_to_the_same_in_any_grouping(spark):
    rows = spark.range(60_000).select((F.col("id") % 40).cast("int").alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("customer"), F.sqrt("id").alias("total"), F.floor(F.sqrt(F.col("id") % 900)).alias("item"))
    daily = sketches.daily_sketches(rows, rows)
    all_at_once = sketches.estimates(sketches.merged(daily, F.lit(0))).first()
    by_weeks = sketches.merged(daily, F.floor(F.col("day") / 7).cast("int")).withColumnRenamed("period", "day")
    in_two_steps = sketches.estimates(sketches.merged(by_weeks, F.lit(0))).first()
    exact = rows.agg(F.countDistinct("customer").alias("n"), F.percentile("total", [0.5, 0.9]).alias("q")).first()
    for told in (all_at_once, in_two_steps):
        assert abs(told.distinct_customers - exact.n) <= sketches.DISTINCT_ERROR * exact.n
        share = rows.agg(*[F.avg((F.col("total") <= q).cast("int")) for q in told.quantiles]).first()
        assert all(abs(s - q) <= sketches.RANK_ERROR for s, q in zip(share, (0.5, 0.9)))
    counts = Counter({r.item: r["count"] for r in rows.groupBy("item").count().collect()})
    assert {t["item"]: t["count"] for t in all_at_once.top_items} == dict(counts.most_common(10)) == {t["item"]: t["count"] for t in in_two_steps.top_items}


def test_sketches_are_stored_and_read(spark, tmp_path):
    rows = spark.range(100).select(F.lit(date(2024, 1, 1)).alias("day"), F.col("id").alias("customer"), F.col("id").cast("double").alias("total"), (F.col("id") % 3).alias("item"))
    sketches.daily_sketches(rows, rows.limit(0)).write.parquet(str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    told = sketches.estimates(sketches.merged(again, F.year("day"))).first()
    assert told.period == 2024 and told.distinct_customers == 100 and not told.top_items


def test_a_day_of_23_hours(spark):
    seconds = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)).total_seconds())
    moments = [(2024, 3, 30, 22, 59), (2024, 3, 30, 23, 0), (2024, 3, 31, 21, 59), (2024, 3, 31, 22, 0)]  # summer time begins in Berlin on 31 March
    orders = spark.createDataFrame([(i, 1 + i // 10, seconds(*m)) for i, m in enumerate(moments)] + [(20, 3, seconds(2024, 3, 31, 22, 0))], "id long, place_id long, created long")
    lines = spark.createDataFrame([(i, 2) for i in range(4)] + [(20, 1), (20, 4), (77, 9)], "order_id long, quantity int")
    places = spark.createDataFrame([(1, "Europe/Berlin"), (3, None)], "id long, zone string")
    got = {(r.place_id, str(r.day)): (r.quantity, r.orders) for r in local_days.local_demand(lines, orders, places).collect()}
    assert got == {(1, "2024-03-30"): (2, 1), (1, "2024-03-31"): (4, 2), (1, "2024-04-01"): (2, 1), (3, "2024-03-31"): (5, 1)}


def test_averages_count_days_and_not_rows(spark):
    draw = random.Random(3)
    rows = [(k, date(2024, 1, 1) + timedelta(days=n), draw.randrange(9), 1) for k in (1, 2) for n in sorted(draw.sample(range(90), 40))]
    daily = spark.createDataFrame(rows, "place_id long, day date, quantity long, orders long")
    filled = local_days.every_day(daily)
    value = {(k, d): q for k, d, q, _ in rows}
    spans = {k: (min(d for k2, d, *_ in rows if k2 == k), max(d for k2, d, *_ in rows if k2 == k)) for k in (1, 2)}
    got = local_days.averages_by_days(filled).collect()
    assert len(got) == sum((b - a).days + 1 for a, b in spans.values())
    for r in got:
        for n in (7, 14):
            days = [r.day - timedelta(days=i) for i in range(1, n + 1)]
            own = [value.get((r.place_id, d), 0) for d in days if d >= spans[r.place_id][0]]
            assert r[f"quantity_{n}d"] == (pytest.approx(sum(own) / len(own)) if own else None)
    sparse = {(r.place_id, r.day): r.quantity_7d for r in local_days.averages_by_days(daily).collect()}
    for (k, d), found in sparse.items():
        own = [value[k, d - timedelta(days=i)] for i in range(1, 8) if (k, d - timedelta(days=i)) in value]
        assert found == (pytest.approx(sum(own) / len(own)) if own else None)


def test_no_message_is_lost(spark):
    texts = [
        '{"order_id":"a","restaurant_id":3,"total_amount":2.5,"options":{"spicy":true,"n":2,"o":{"x":[1]}},"coupon":"X","table":{"no":4}}',
        '{"order_id":7,"restaurant_id":"three","total_amount":"much"}', '{"options":[1,2]}', "{}", "[1]", "7", '"text"', "null", "", None, '{"order_id":"b"', "not json", '{"order_id":"c","order_id":"d"}',
    ]
    found, broken = messages.read_messages(spark.createDataFrame([(t,) for t in texts], "value string"))
    rows = found.drop("message").collect()
    assert len(rows) + broken.count() == len(texts)
    first = next(r for r in rows if r.order_id == "a")
    assert (first.restaurant_id, first.total_amount) == (3, 2.5) and first.options["spicy"] == "true" and first.options["n"] == "2"
    assert {k: json.loads(v) if v[0] == "{" else v for k, v in first.rescued.items()} == {"coupon": "X", "table": {"no": 4}}
    odd = next(r for r in rows if r.order_id == "7")
    assert odd.restaurant_id is None and odd.total_amount is None and odd.options == {}
    assert {r.text for r in broken.collect()} >= {"[1]", "7", "", None, '{"order_id":"b"', "not json"}
    counts = {(r.option, r.value): r.orders for r in messages.option_counts(found).collect()}
    assert counts["spicy", "true"] == 1 and messages.options_of_places(found).where("restaurant_id = 3").first().options["n"] == 1


def test_sql_functions_are_expressions(spark, tables):
    extended.named_views(tables)
    by_sql = spark.sql("SELECT item_id, larder_safe_division(total_cost, quantity) AS x FROM fct_order_items")
    by_frame = tables.order_items.select("item_id", F.expr("CASE WHEN quantity IS NULL OR quantity = 0 THEN 0D ELSE total_cost / quantity END").alias("x"))
    plan = by_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BatchEval" not in plan
    scans = [df._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).output().size() for df in (by_sql, by_frame)]
    assert scans[0] == scans[1]  # the same columns are read
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_frame.collect()))
    table = spark.sql("SELECT item_id, revenue FROM larder_item_sales(500D)")
    frame = tables.order_items.groupBy("item_id").agg(F.sum("quantity").alias("q"), F.sum("total_cost").alias("revenue")).where("q >= 500").select("item_id", "revenue")
    assert {r.item_id for r in table.collect()} == {r.item_id for r in frame.collect()}
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString()


def test_rules_of_sql_functions(spark):
    register_functions(spark)
    one = spark.sql(
        """SELECT larder_safe_division(3, 0) AS a, larder_safe_division(NULL, 2) AS b, larder_safe_division(3, 2) AS c, larder_stock_level(0, 1, 2, 40) AS d,
                  larder_stock_level(5, 1, 9, 40) AS e, larder_stock_level(50, 1, 9, 40) AS f, larder_stock_level(50, 1, 9, 15) AS g, larder_stock_level(50, 1, 9, 5) AS h,
                  larder_reorder_point(10, 2, 4, 1.65) AS i, larder_menu_class(9, 1, 5, 2) AS j"""
    ).first()
    assert tuple(one) == (0.0, None, 1.5, "critical", "low", "excess", "high", "optimal", 47.0, "plowhorse")


@pytest.mark.parametrize("file_format", ["parquet", "orc"])
def test_bucketed_tables_join_without_an_exchange(spark, tables, tmp_path, file_format):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n) for n in names}
    prefix = f"t_{uuid.uuid4().hex[:8]}"
    try:
        for n in names:
            spark.conf.set(n, "-1")
        orders, lines = stored.store_orders(spark, tables.orders, tables.order_items, prefix, str(tmp_path / "s"), 4, file_format)
        joined = stored.stored_order_lines(orders, lines)
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text
        assert joined.count() == tables.order_items.count()
        daily = stored.store_daily_demand(joined, f"{prefix}_demand", str(tmp_path / "d"), file_format)
        picked = daily.where("month = '1996-03'")
        scan = picked._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month" in scan
        assert {f.split("month=")[1][:7] for f in daily.inputFiles()} > {"1996-03"} and picked.count() == daily.where("date_format(date, 'yyyy-MM') = '1996-03'").count() > 0
    finally:
        for n in names:
            spark.conf.set(n, old[n])
        for name in ("orders", "lines", "demand"):
            spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


def test_buckets_and_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """More rows, more buckets; a value's rows stand in few files, however many tasks hold them."""
    assert stored.buckets_for(spark.range(1000)) == 8
    monkeypatch.setattr(stored, "ROWS_PER_BUCKET", 100)
    assert stored.buckets_for(spark.range(1001)) == 11
    rows = spark.range(0, 400, 1, 8).select("id", (F.col("id") % 3).alias("part"))
    kept = stored.store_partitioned(rows, "kept_by_part", "part", str(tmp_path / "kept"))
    assert kept.count() == 400 and len(list((tmp_path / "kept").glob("part=*/*.parquet"))) == 3
    spark.sql("DROP TABLE kept_by_part")
