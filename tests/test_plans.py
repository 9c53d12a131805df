"""What the physical plans look like, and the report chains end to end."""

import pytest
from pyspark.sql import functions as F

from larder.functions import labels as L
from larder.operators import behavior, conversations, dashboard, forecast, inventory
from larder.plans.menu import menu_report
from larder.plans.models import load_fitted
from larder.plans.stock import stock_report
from larder.registry import ENTRIES
from larder.session import INITIAL_PARTITIONS, STORED_BYTES, configure, shuffles_for
from larder.sources.standins import Standins

SF = "/root/testdata/sf0.001"
# One or two queries per family; check.py --plans looks at all of them.
SHAPES = (
    "cb4_temporal_insights cb8_co_purchased_items cb9_restaurant_performance db6_dashboard_summary dq3_integrity_check "
    "fc7_demand_lags fc12_request_features in6_stock_alerts in20_weekly_recommendations lg1_trim_history "
    "me6_menu_category_metrics me18_price_histogram me21_item_scores pf1_profile_orders pr6_request_features"
).split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SHAPES)
def test_no_cross_join_and_no_python_in_plans(spark, name):
    text = plan(ENTRIES[name].run(spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert word not in text


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are between two large tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.set(n, old[n])


def big_tables(spark):
    orders = spark.range(100).select("id", (F.col("id") % 5).alias("place_id"), (F.col("id") * 3600).alias("created"))
    lines = spark.range(500).select(
        (F.col("id") % 100).alias("order_id"), (F.col("id") % 7).alias("item_id"), F.lit(1.0).alias("quantity"),
        F.lit(2.0).alias("price"), F.lit(1.0).alias("cost"),
    )
    return lines, orders


def test_daily_demand_shuffles_lines_once(spark, no_broadcast):
    """Two shuffles for the join, one for the small result; the distinct count rides on the join's partitioning."""
    lines, orders = big_tables(spark)
    assert plan(forecast.daily_demand(forecast.order_lines(lines, orders))).count("Exchange hashpartitioning") == 3


def test_order_facts_shuffle_lines_once(spark, no_broadcast):
    lines, orders = big_tables(spark)
    text = plan(behavior.monthly_pattern(behavior.order_facts(lines, orders)))
    assert text.count("Exchange hashpartitioning") == 3


def test_caps_are_applied_before_the_shuffle(spark):
    turns = spark.range(100).select((F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"))
    assert "WindowGroupLimit" in plan(conversations.trim_history(turns, 4))
    alerts = spark.range(50).select(
        F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, L.CRITICAL).otherwise(L.LOW).alias("status")
    )
    assert "WindowGroupLimit" in plan(inventory.first_per_status(alerts, {L.CRITICAL: 3, L.LOW: 2}))


def test_filters_and_columns_reach_the_scan(spark, tables):
    text = plan(behavior.order_type_counts(tables.orders.where("type = '2-HIGH'")))
    assert "EqualTo(o_orderpriority,2-HIGH)" in text
    text = plan(behavior.top_items(tables.order_items))
    assert "l_tax" not in text and "l_discount" not in text


def test_a_hot_order_is_split(spark, no_broadcast):
    """One order holds a third of all lines: the adaptive skew join cuts its partition."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        orders = spark.range(2000).select("id", (F.col("id") % 5).alias("place_id"), (F.col("id") * 3600).alias("created"))
        lines = spark.range(0, 60_000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).alias("order_id"),
            (F.col("id") % 50).alias("item_id"),
            F.rand(1).alias("quantity"),
            F.rand(2).alias("price"),
            F.rand(3).alias("cost"),
        )
        df = forecast.daily_demand(forecast.order_lines(lines, orders))
        df.collect()
        assert "skew=true" in plan(df)
        assert df.agg(F.sum("num_orders")).first()[0] == lines.select("order_id", "item_id").distinct().count()
    finally:
        for key in small:
            spark.conf.unset(key)


def test_stock_report(tables):
    data = {"fct_orders": tables.orders, "fct_order_items": tables.order_items, "dim_items": tables.items}
    results = stock_report(data, tables.current_inventory)
    summary = results["summary"].first().asDict(recursive=True)
    assert summary["data_overview"]["total_orders"] == tables.orders.count()
    counts = summary["inventory_alerts"]
    assert sum(counts.values()) == results["alerts"].count()
    assert results["analysis"].count() == tables.order_items.select("item_id").distinct().count()
    assert results["hourly"].count() == 24


def test_reports_return_models_and_release_frames(spark, tables, tmp_path):
    with menu_report({"most_ordered": tables.most_ordered, "dim_items": tables.items}) as report:
        assert report["performance"].storageLevel.useMemory and set(report.models) == {"clusters"}
        labels = {r.item_id: r.cluster for r in report["clusters"].collect()}
        report.save_models(str(tmp_path))
    assert not report["performance"].storageLevel.useMemory
    again = load_fitted(spark, f"{tmp_path}/clusters")
    assert again.features == report.models["clusters"].features and len(again.centres) == len(report.models["clusters"].centres)
    assert {r.item_id: r.cluster for r in report["clusters"].collect()} == labels


def test_headline_figures_share_one_scan_of_the_orders(spark, tmp_path):
    """One scan for all figures but the median, whose own is the second one in the plan."""
    orders = spark.createDataFrame(
        [(1, 1, 0, 10.0), (2, 1, 3600 * 30, 20.0), (3, None, 3600 * 30, None), (4, 2, None, 40.0)],
        "id long, place_id long, created long, total_amount double",
    )
    lines = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (None, 1, 5.0)], "order_id long, item_id long, quantity double")
    orders.write.parquet(f"{tmp_path}/orders")
    stored = spark.read.parquet(f"{tmp_path}/orders")
    counts = spark.sql("SELECT 1L AS critical_items, 2L AS low_stock_items, 3L AS excess_items")
    summary = dashboard.dashboard_summary(stored, lines, spark.range(3), counts)
    scans = [x for x in plan(summary).split("Scan parquet")[1:] if "/orders" in x]
    assert len(scans) == 2
    row = summary.first().asDict()
    apart = {**dashboard.peak_by_mode(orders).first().asDict(), **dashboard.order_value_stats(orders).first().asDict(), **dashboard.orders_per_day(orders).first().asDict()}
    assert {k: row[k] for k in apart} == apart
    assert (row["total_orders"], row["restaurants"], row["total_order_items"], row["menu_items"]) == (4, 2, 3, 3)
    assert (row["peak_hour"], row["weekend_pct"], row["avg_order_value"], row["median_order_value"]) == (6, 0.0, 23.33, 20.0)


def test_menu_report(tables):
    results = menu_report({"most_ordered": tables.most_ordered, "dim_items": tables.items})
    n = results["performance"].count()
    assert results["classification"].count() == results["recommendations"].count() == results["clusters"].count() == n
    assert results["category_metrics"].agg(F.sum("item_count")).first()[0] == n
    assert results["opportunity"].first()["items_to_reprice"] == results["pricing"].count()


def test_tasks_read_little_however_large_the_tables(spark, tmp_path):
    """Files are cut and shuffled partitions merged by few bytes, so that more rows make more tasks and not larger ones."""
    configure(spark)  # other tests unset some of it
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16MB" and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4MB"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        kept = spark.range(6_000_000).select("id", F.xxhash64("id").alias("k")).groupBy("k").agg(F.max("id").alias("id"))
        sizes = kept.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r["count"] for r in sizes) == 6_000_000 and max(r["count"] for r in sizes) < 500_000


def test_shuffles_begin_with_more_partitions_for_more_stored_rows(spark):
    """With the cluster's own few partitions a task would hold half of any table, as aggregates are never cut while running."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    kept = spark.range(4_000_000).select("id", F.xxhash64("id").alias("k")).groupBy("k").agg(F.max("id").alias("id"))
    try:
        shuffles_for(spark, 31 * STORED_BYTES + 1)
        sizes = kept.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 4_000_000 and max(r["count"] for r in sizes) < 600_000
        assert spark.conf.get(INITIAL_PARTITIONS) == "32"
        shuffles_for(spark, 2 * STORED_BYTES)  # the cluster's own number is enough
        assert spark.conf.get(INITIAL_PARTITIONS, None) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        shuffles_for(spark, 0)


def test_queries_size_their_shuffles_by_the_order_tables(spark, tmp_path, monkeypatch):
    """Files and folders of files count, other tables do not; the rows stay the same."""
    for name, rows in (("customer", 10), ("lineitem", 1000), ("documents", 5000)):
        spark.range(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    size = lambda *names: sum(f.stat().st_size for n in names for f in (tmp_path / f"{n}.parquet").glob("*.parquet"))
    assert Standins(spark, str(tmp_path)).stored_bytes() == size("customer", "lineitem")

    query = ENTRIES["fc7_demand_lags"].run
    plain = query(spark, SF).collect()
    monkeypatch.setattr("larder.session.STORED_BYTES", 4096)
    try:
        finer = query(spark, SF).collect()
        assert int(spark.conf.get(INITIAL_PARTITIONS)) > 8
    finally:
        shuffles_for(spark, 0)
    key = lambda r: (r["item_id"], r["place_id"], r["date"])
    assert sorted(finer, key=key) == sorted(plain, key=key)
