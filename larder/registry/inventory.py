"""Stock policy, status, alerts and weekly actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larder.functions import labels as L
from larder.operators import forecast, inventory, weekly
from larder.plans import stock
from larder.plans.weekly import weekly_report_without_uploads
from larder.registry.base import query, r, rounded
from larder.registry.menu import classified
from larder.session import scratch_path, written
from larder.sources import schemas
from larder.sources.stock import ingest_inventory
from larder.sources.tables import load_transactional
from larder.streaming import sinks
from larder.streaming import stock as stock_stream

FRIDAY = dt.date(2024, 1, 5)


def daily(t):
    return forecast.daily_demand(forecast.order_lines(t.order_items, t.orders))


def stats(t):
    return inventory.demand_stats(daily(t))


def policy(t):
    return inventory.stock_policy(stats(t))


def analysis(t):
    return stock.analysed_stock(t.order_items, t.orders, t.items, t.current_inventory)


def alerts(t):
    return inventory.stock_alerts(analysis(t))


def names(t):
    return inventory.item_name_lookup(t.inventory_reports, t.items)


def given_demand(t):
    return stats(t).select("item_id", (F.col("total_demand") / 730).alias("daily_demand"))


def stock_actions(t):
    latest = inventory.latest_report(t.inventory_reports)
    return weekly.weekly_stock_actions(latest, given_demand(t), names(t))


DIGITS = dict(avg_daily_demand=4, demand_std=4, avg_price=4)
STATS_SQL = f"item_id, {r('avg_daily_demand', 4)}, {r('demand_std', 4)}, total_demand, days_with_demand, {r('avg_price', 4)}"
POLICY_SQL = f"{STATS_SQL}, safety_stock, reorder_point, eoq"
ANALYSIS_SQL = f"{POLICY_SQL}, item_name, current_stock, status, days_of_stock, recommended_order_qty"


@query("in1_demand_stats", f"SELECT {STATS_SQL} FROM demand_stats")
def in1(t):
    return rounded(stats(t), **DIGITS)


@query("in2_stock_policy", f"SELECT {POLICY_SQL} FROM policy")
def in2(t):
    return rounded(policy(t), **DIGITS)


@query("in3_stock_policy_named", f"SELECT {POLICY_SQL}, title AS item_name FROM policy LEFT JOIN dim_items ON item_id = id")
def in3(t):
    return rounded(inventory.with_item_names(policy(t), t.items), **DIGITS)


@query("in4_stock_status", "SELECT item_id, current_stock, status, days_of_stock FROM analysis")
def in4(t):
    joined = policy(t).join(t.current_inventory, "item_id", "left").fillna(0.0, subset=["current_stock"])
    s, mean = F.col("current_stock"), F.col("avg_daily_demand")
    return joined.select(
        "item_id",
        "current_stock",
        inventory.stock_status(s, mean, F.col("safety_stock"), F.col("reorder_point")).alias("status"),
        F.coalesce(F.bround(inventory.days_of_stock(s, mean), 1), F.lit(999.0)).alias("days_of_stock"),
    )


@query("in5_inventory_analysis", f"SELECT {ANALYSIS_SQL} FROM analysis")
def in5(t):
    return rounded(analysis(t), **DIGITS)


@query("in6_stock_alerts", f"SELECT {ANALYSIS_SQL} FROM alerts")
def in6(t):
    return rounded(alerts(t), **DIGITS)


@query("in7_alert_counts", "SELECT * FROM alert_totals")
def in7(t):
    return inventory.alert_counts(alerts(t))


@query(
    "in8_alert_top_per_status",
    """SELECT status, CAST(rn AS INTEGER) AS position, item_id, item_name, current_stock, recommended_order_qty, days_of_stock
       FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY item_id) AS rn FROM alerts) WHERE rn <= 10""",
)
def in8(t):
    return inventory.alert_top_per_status(alerts(t))


@query(
    "in9_ingredient_requirements",
    f"""SELECT b.sku_id AS ingredient_id, {r('sum(avg_daily_demand * b.quantity)', 2, 'total_qty_needed')},
               count(DISTINCT parent_sku_id) AS used_in_n_items
        FROM demand_stats JOIN dim_bill_of_materials b ON item_id = parent_sku_id GROUP BY b.sku_id""",
)
def in9(t):
    forecasted = stats(t).select("item_id", F.col("avg_daily_demand").alias("predicted_demand"))
    return rounded(inventory.ingredient_requirements(forecasted, t.bill_of_materials), total_qty_needed=2)


@query(
    "in10_optimization_summary",
    f"""SELECT count(*) AS total_items_analyzed, {r('sum(avg_daily_demand)', 0, 'avg_daily_demand_all_items')},
               {r('sum(safety_stock)', 0, 'total_safety_stock_needed')}, {r('avg(reorder_point)', 1, 'avg_reorder_point')},
               2.0::DOUBLE AS lead_time_days, '95%' AS service_level, 1.64::DOUBLE AS z_score FROM policy""",
)
def in10(t):
    return inventory.optimization_summary(policy(t))


@query(
    "in11_status_distribution",
    f"""SELECT substr(split_part(status, ' - ', 1), 3) AS status, count(*) AS items,
               {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM analysis)', 4, 'pct')} FROM analysis GROUP BY 1""",
)
def in11(t):
    return rounded(inventory.status_distribution(analysis(t)), pct=4)


@query(
    "in12_lowest_days_of_stock",
    """SELECT item_id, item_name, current_stock, status, days_of_stock FROM analysis
       WHERE status LIKE '%Critical%' OR status LIKE '%Low%' ORDER BY days_of_stock, item_id LIMIT 20""",
)
def in12(t):
    return inventory.lowest_days_of_stock(analysis(t)).select(
        "item_id", "item_name", "current_stock", "status", "days_of_stock"
    )


UPLOAD_SQL = f"""
    SELECT item_id, coalesce(title, 'Item ' || item_id) AS item_name, current_stock, reorder_point, safety_stock,
           CASE WHEN current_stock <= safety_stock THEN '🔴 Critical - Stockout Risk'
                WHEN current_stock <= reorder_point THEN '🟠 Low - Reorder Soon'
                WHEN reorder_point > 0 AND current_stock > reorder_point * 3 THEN '🔵 Excess - Overstock Risk'
                ELSE '✅ OK' END AS status,
           {r('current_stock / greatest(reorder_point * 0.1::DOUBLE, 1)', 1, 'days_of_stock')},
           greatest(0, reorder_point - current_stock) AS recommended_order_qty"""


@query("in13_upload_status", UPLOAD_SQL + " FROM inventory_reports LEFT JOIN dim_items d ON item_id = d.id")
def in13(t):
    return inventory.upload_status(t.inventory_reports, t.items)


@query("in14_latest_report", "SELECT * FROM latest_reports")
def in14(t):
    return inventory.latest_report(t.inventory_reports).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    "in15_item_name_lookup",
    """WITH ids AS (SELECT DISTINCT item_id + 500 AS item_id FROM inventory_reports),
            d AS (SELECT id, title FROM dim_items),
            m AS (SELECT item_id, min(item_name) AS n FROM most_ordered GROUP BY item_id),
            v AS (SELECT id + 250 AS id, min(title) AS n FROM dim_items GROUP BY ALL)
       SELECT ids.item_id, coalesce(d.title, m.n, v.n, 'Item ' || ids.item_id) AS item_name
       FROM ids LEFT JOIN d ON ids.item_id = d.id LEFT JOIN m ON ids.item_id = m.item_id LEFT JOIN v ON ids.item_id = v.id""",
)
def in15(t):
    ids = t.inventory_reports.select((F.col("item_id") + 500).alias("item_id"))
    live = t.live_menu_items.withColumn("id", F.col("id") + 250)  # items that only the live menu knows
    return inventory.item_name_lookup(ids, t.items, t.most_ordered, live)


@query("in16_weekly_stock_actions", "SELECT item_id, kind, item, message, priority FROM kept_stock_messages")
def in16(t):
    return stock_actions(t).select("item_id", "kind", "item", "message", "priority")


@query("in17_weekly_capped_actions", "SELECT * FROM capped_actions")
def in17(t):
    return weekly.weekly_capped_actions(written(stock_actions(t), "actions"))


# The newest reports (the third copy) as a file of text columns; its rows carry no id, as those of real uploads.
UPLOAD_DATE = "2024-01-04 00:00:00"
UPLOAD_COLUMNS = ["Item_ID", "Current_Stock", "Reorder_Point", "Safety_Stock"]


def write_upload(t, folder):
    newest = t.inventory_reports.where("id % 10 = 3").select("item_id", "current_stock", "reorder_point", "safety_stock")
    newest.toDF(*UPLOAD_COLUMNS).write.option("header", True).csv(folder)


def actions_of(t, reports):
    latest = inventory.latest_report(reports)
    return weekly.weekly_capped_actions(written(weekly.weekly_stock_actions(latest, given_demand(t), names(t)), "actions"))


@query("in17_actions_from_a_file", "SELECT * FROM capped_actions")
def in17_file(t):
    base = scratch_path(t.spark, "upload")
    write_upload(t, f"{base}/in")
    ingest_inventory(t.spark, f"{base}/in", base, F.lit(UPLOAD_DATE))
    return actions_of(t, load_transactional(t.spark, base, "inventory_reports", schemas.INVENTORY_REPORT))


@query("in17_actions_from_a_stream", "SELECT * FROM capped_actions")
def in17_stream(t):
    base = scratch_path(t.spark, "upload")
    write_upload(t, f"{base}/in")
    raw = stock_stream.read_stock_files(t.spark, f"{base}/in", UPLOAD_COLUMNS, files_per_batch=None)
    stock_stream.stream_inventory(raw, f"{base}/out", f"{base}/state").awaitTermination()
    reports = sinks.read_batches(t.spark, f"{base}/out/inventory_reports", schemas.INVENTORY_REPORT)
    return actions_of(t, reports.drop("batch_id"))


WHOLE_MENU_TEXTS = {
    L.STAR: (L.KIND_STARS, L.MSG_STARS),
    L.DOG: (L.KIND_DOGS, L.MSG_DOGS),
    L.PUZZLE: (L.KIND_PUZZLES, L.MSG_PUZZLES),
    L.PLOWHORSE: (L.KIND_PLOWHORSES, L.MSG_PLOWHORSES),
}


def _case(position):
    quoted = {c: t[position].replace("'", "''") for c, t in WHOLE_MENU_TEXTS.items()}
    return "CASE category " + " ".join(f"WHEN '{c}' THEN '{text}'" for c, text in quoted.items()) + " END"


WHOLE_MENU = f"""SELECT {_case(0)} AS kind, printf('%d Menu Items', count(*)) AS item, {_case(1)} AS message,
    CASE WHEN category IN ('{L.DOG}', '{L.PUZZLE}') THEN 'Medium' ELSE 'Low' END AS priority FROM classified GROUP BY category"""


@query("in18_weekly_menu_actions_whole_menu", WHOLE_MENU)
def in18_whole(t):
    return weekly.weekly_menu_actions(classified(t), named=False)


@query(
    "in20_weekly_without_uploads",
    f"""SELECT * FROM alert_actions UNION ALL SELECT * FROM ({WHOLE_MENU}) UNION ALL
        SELECT '{L.KIND_WEEKEND}', 'Staffing & Inventory', '{L.MSG_WEEKEND}', 'Medium'""",
)
def in20_without(t):
    return weekly_report_without_uploads(written(alerts(t), "alerts"), classified(t), FRIDAY)


@query("in18_weekly_menu_actions", "SELECT * FROM named_menu_actions")
def in18(t):
    return weekly.weekly_menu_actions(classified(t))


@query("in19_weekly_actions_from_alerts", "SELECT * FROM alert_actions")
def in19(t):
    found = inventory.stock_alerts(written(analysis(t), "analysis"))
    return weekly.weekly_actions_from_alerts(found, inventory.alert_counts(found))


@query(
    "in20_weekly_recommendations",
    """SELECT * FROM capped_actions UNION ALL SELECT * FROM named_menu_actions UNION ALL
       SELECT '📅 Weekend Prep', 'Staffing & Inventory',
              'Weekend peak expected. Ensure adequate staffing and stock levels for high-demand items.', 'Medium'""",
)
def in20(t):
    actions = weekly.weekly_capped_actions(written(stock_actions(t), "actions"))
    return weekly.weekly_recommendations(actions, weekly.weekly_menu_actions(classified(t)), FRIDAY)


@query(
    "in21_search_alerts",
    "SELECT item_id, item_name, status, days_of_stock FROM alerts WHERE lower(item_name) LIKE '%ring%'",
)
def in21(t):
    return inventory.search_alerts(alerts(t), "RING").select("item_id", "item_name", "status", "days_of_stock")
