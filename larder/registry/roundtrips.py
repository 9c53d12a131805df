"""Sources and sinks: whole tables are written to the shared folder and read back the way users read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from larder.functions.scalars import require_columns
from larder.operators import behavior, clusters, forecast, inventory, menu, prediction
from larder.registry.base import TABLES, named_tables, query, r, rounded
from larder.registry.inventory import analysis
from larder.registry.menu import classified, performance
from larder.registry.models import _clusters, _predictors, fitted
from larder.session import scratch_path, written
from larder.sources import schemas, sinks, tables
from larder.sources.orders import append_menu_items, append_orders, append_restaurants

ORDER_COLUMNS = ["id", "place_id", "created", "total_amount", "type", "payment_method", "source", "status"]


def as_csv(name: str, df: DataFrame, base: str) -> None:
    df.write.option("header", True).csv(f"{base}/{name}.csv")


@query(
    "src1_load_table",
    """SELECT id, CAST(place_id AS BIGINT) AS place_id, created, total_amount, type, payment_method, source, status
       FROM fct_orders""",
)
def src1(t):
    base = scratch_path(t.spark, "tables")
    as_csv("fct_orders", t.orders, base)
    return tables.load_table(t.spark, base, "fct_orders")


@query("src2_load_catalog", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in TABLES))
def src2(t):
    base = scratch_path(t.spark, "catalog")
    for name, df in named_tables(t).items():
        as_csv(name, df, base)
    found = tables.load_catalog(t.spark, base, views=False)
    counts = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, d in found.items()]
    return reduce(DataFrame.unionByName, counts)


@query(
    "src3_load_transactional",
    f"""SELECT menu_item_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity, {r('sum(price_at_time)', 4, 'prices')}
        FROM live_order_items GROUP BY menu_item_id""",
)
def src3(t):
    base = scratch_path(t.spark, "live")
    append_orders(t.order_messages, base, F.lit("2024-02-01"))
    lines = tables.load_transactional(t.spark, base, "order_items", schemas.LIVE_ORDER_ITEMS)
    per = lines.groupBy("menu_item_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"), F.sum("price_at_time").alias("prices")
    )
    return rounded(per, prices=4)


@query(
    "src5_append_menu_items",
    """SELECT id, id % 25 AS restaurant_id, title AS name, price, type AS category, CAST(NULL AS VARCHAR) AS description
       FROM dim_items""",
)
def src5(t):
    base = scratch_path(t.spark, "live")
    rows = t.live_menu_items.drop("description")
    append_menu_items(rows.where("id % 2 = 0"), base)
    append_menu_items(rows.where("id % 2 = 1"), base)
    return tables.load_transactional(t.spark, base, "menu_items", schemas.LIVE_MENU_ITEMS)


@query("src5_append_restaurants", "SELECT CAST(id AS BIGINT) AS id, title AS name, country AS location FROM dim_places")
def src5_places(t):
    base = scratch_path(t.spark, "live")
    append_restaurants(t.places.select("id", F.col("title").alias("name"), F.col("country").alias("location")), base)
    return tables.load_transactional(t.spark, base, "restaurants", schemas.RESTAURANTS)


@query(
    "snk1_export_menu_results",
    f"""SELECT 'classification' AS result, item_id, category AS label, {r('revenue', 2, 'value')} FROM classified
        UNION ALL SELECT 'clusters', item_id, 'labelled', {r('price', 2, 'value')} FROM classified
        UNION ALL SELECT 'recommendations', c.item_id, a.action, CAST(a.priority AS DOUBLE) FROM classified c JOIN category_actions a ON c.category = a.category
        UNION ALL SELECT 'pricing', item_id, item_name, {r('revenue_gain', 2, 'value')} FROM suggestions""",
)
def snk1(t):
    """All four results, written as CSV and read back."""
    found = classified(t)
    results = {
        "classification": found,
        "clusters": clusters.item_clusters(fitted(_clusters, t), found),
        "recommendations": menu.menu_recommendations(found),
        "pricing": menu.pricing_suggestions(found),
    }
    paths = sinks.export_menu_results(results, scratch_path(t.spark, "exports"))
    wanted = {
        "classification": (F.col("category"), "revenue"),
        "clusters": (F.when(F.col("cluster").between(0, 3), "labelled"), "price"),
        "recommendations": (F.col("action"), "priority"),
        "pricing": (F.col("item_name"), "revenue_gain"),
    }
    parts = []
    for key, (label, value) in wanted.items():
        back = t.spark.read.schema(results[key].schema).option("header", True).option("enforceSchema", False).csv(paths[key])
        parts.append(rounded(back.select(F.lit(key).alias("result"), "item_id", label.alias("label"), F.col(value).cast("double").alias("value")), value=2))
    return reduce(DataFrame.unionByName, parts)


@query(
    "snk2_export_inventory_results",
    f"""SELECT 'hourly' AS result, CAST(hour AS BIGINT) AS key, {r('sum(price)', 2, 'value')} FROM order_lines GROUP BY hour
        UNION ALL SELECT 'analysis', item_id, {r('recommended_order_qty', 2, 'value')} FROM analysis
        UNION ALL SELECT 'alerts', item_id, {r('current_stock', 2, 'value')} FROM alerts
        UNION ALL SELECT 'summary', critical_items, CAST(low_stock_items + excess_items AS DOUBLE) FROM alert_totals
        UNION ALL SELECT 'importance', count(*), 1.0 FROM (SELECT unnest(['price', 'rating', 'votes', 'index', 'price_bucket', 'rating_score', 'log_price']))""",
)
def snk2(t):
    """All five results, written as CSV and read back."""
    whole = written(analysis(t), "analysis")
    alerts = inventory.stock_alerts(whole)
    model = fitted(_predictors, t).models["random_forest"]
    results = {
        "hourly": behavior.hourly_pattern(behavior.order_facts(t.order_items, t.orders)),
        "analysis": whole,
        "alerts": alerts,
        "summary": inventory.alert_counts(alerts),
        "importance": forecast.feature_importance(model, prediction.FEATURES, t.menu_items),
    }
    paths = sinks.export_inventory_results(results, scratch_path(t.spark, "exports"))
    wanted = {"hourly": ("hour", "total_revenue"), "analysis": ("item_id", "recommended_order_qty"), "alerts": ("item_id", "current_stock")}
    back = {k: t.spark.read.schema(d.schema).option("header", True).option("enforceSchema", False).csv(paths[k]) for k, d in results.items()}
    parts = [rounded(back[k].select(F.lit(k).alias("result"), F.col(a).cast("long").alias("key"), F.col(b).cast("double").alias("value")), value=2) for k, (a, b) in wanted.items()]
    counts = back["summary"].select(F.lit("summary").alias("result"), "critical_items", (F.col("low_stock_items") + F.col("excess_items")).cast("double"))
    total = rounded(back["importance"].agg(F.count(F.lit(1)).alias("key"), F.sum("importance").alias("value")), value=4)
    parts += [counts.toDF("result", "key", "value"), total.select(F.lit("importance").alias("result"), "key", "value")]
    return reduce(DataFrame.unionByName, parts)


SUMMARY_SQL = """SELECT (SELECT count(*) FROM dim_items) AS total_items, (SELECT count(DISTINCT place_id) FROM fct_orders) AS total_restaurants,
              (SELECT count(*) FROM fct_orders) AS total_orders, (SELECT count(*) FROM fct_order_items) AS total_order_items,
              (SELECT count(*) FROM dim_campaigns) AS total_campaigns,
              count(*) FILTER (WHERE category = '⭐ Star') AS stars, count(*) FILTER (WHERE category = '🐴 Plowhorse') AS plowhorses,
              count(*) FILTER (WHERE category = '❓ Puzzle') AS puzzles, count(*) FILTER (WHERE category = '🐕 Dog') AS dogs
       FROM classified"""


def read_summary(t, file_format):
    summary = menu.menu_summary(t.items, t.orders, t.order_items, t.campaigns, classified(t))
    path = sinks.export_summary(summary, scratch_path(t.spark, "summary"), file_format)
    reader = t.spark.read.schema(summary.schema)
    return reader.json(path) if file_format == "json" else reader.option("header", True).csv(path)


@query("snk3_export_summary", SUMMARY_SQL)
def snk3(t):
    return read_summary(t, "json")


@query("snk3_export_summary_csv", SUMMARY_SQL)
def snk3_csv(t):
    return read_summary(t, "csv")


@query("snk4_save_load_thresholds", f"SELECT {r('popularity', 4)}, {r('profitability', 4)} FROM thresholds")
def snk4(t):
    path = scratch_path(t.spark, "thresholds")
    sinks.save_thresholds(menu.menu_thresholds(performance(t)), path)
    return rounded(sinks.load_thresholds(t.spark, path), popularity=4, profitability=4)


@query("dq4_require_columns", "SELECT status, count(*) AS orders FROM fct_orders GROUP BY status")
def dq4(t):
    checked = require_columns(t.orders, ORDER_COLUMNS, "fct_orders")
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))
