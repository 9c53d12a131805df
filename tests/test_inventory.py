"""Stock policy, status, uploads and weekly actions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.functions import labels as L
from larder.operators import inventory, weekly
from larder.plans.weekly import weekly_report, weekly_report_without_uploads


@pytest.mark.parametrize(
    "stock,mean,safety,reorder,expected",
    [
        (0.0, 1.0, 0.0, 0.0, L.CRITICAL),
        (-1.0, 0.0, -5.0, 0.0, L.CRITICAL),
        (4.0, 1.0, 5.0, 10.0, L.CRITICAL),
        (5.0, 1.0, 5.0, 10.0, L.LOW),
        (10.0, 1.0, 5.0, 10.0, L.OPTIMAL),
        (14.0, 1.0, 5.0, 10.0, L.OPTIMAL),
        (14.5, 1.0, 5.0, 10.0, L.HIGH),
        (30.0, 1.0, 5.0, 10.0, L.HIGH),
        (30.5, 1.0, 5.0, 10.0, L.EXCESS),
        (50.0, 0.0, 5.0, 10.0, L.EXCESS),
    ],
)
def test_status(spark, stock, mean, safety, reorder, expected):
    df = spark.createDataFrame([(stock, mean, safety, reorder)], "s double, m double, f double, r double")
    assert df.select(inventory.stock_status(*[F.col(c) for c in "smfr"])).first()[0] == expected


def test_policy_rounds_half_even_and_in_steps(spark):
    stats = spark.createDataFrame(
        [(1, 10.0, 3.0, 365.0), (2, 1.25, 0.0, 0.0), (3, 1.75, 0.0, None)],
        "item_id int, avg_daily_demand double, demand_std double, avg_price double",
    )
    rows = {r["item_id"]: r for r in inventory.stock_policy(stats).collect()}
    assert (rows[1]["safety_stock"], rows[1]["reorder_point"]) == (7.0, 27.0)  # 1.645 * 3 * sqrt 2 = 6.98
    assert rows[1]["eoq"] == 71.0  # sqrt(2 * 3650 * 50 / 73) = 70.7
    assert rows[2]["reorder_point"] == 2.0 and rows[3]["reorder_point"] == 4.0
    assert rows[2]["eoq"] == 214.0 and rows[3]["eoq"] is None


def test_single_day_spread_is_a_fifth_of_the_mean(spark):
    daily = spark.createDataFrame([(1, 10.0, 2.0), (None, 1.0, 1.0)], "item_id int, quantity_demanded double, avg_price double")
    rows = inventory.demand_stats(daily).collect()
    assert len(rows) == 1 and rows[0]["demand_std"] == 2.0


def test_analysis_of_unknown_stock(spark):
    policy = spark.createDataFrame(
        [(1, 2.0, 5.0, 9.0, 20.0), (2, 0.0, 0.0, 0.0, 3.0)],
        "item_id int, avg_daily_demand double, safety_stock double, reorder_point double, eoq double",
    )
    stock = spark.createDataFrame([(2, 10.0)], "item_id int, current_stock double")
    rows = {r["item_id"]: r for r in inventory.inventory_analysis(policy, stock).collect()}
    assert (rows[1]["status"], rows[1]["days_of_stock"], rows[1]["recommended_order_qty"]) == (L.CRITICAL, 0.0, 25.0)
    assert (rows[2]["status"], rows[2]["days_of_stock"], rows[2]["recommended_order_qty"]) == (L.EXCESS, 999.0, 0.0)


def test_upload_rule(spark):
    reports = spark.createDataFrame(
        [(1, 5.0, 10.0, 5.0), (2, 10.0, 10.0, 2.0), (3, 31.0, 10.0, 2.0), (4, 30.0, 10.0, 2.0), (5, 9.0, None, None)],
        "item_id int, current_stock double, reorder_point double, safety_stock double",
    )
    names = spark.createDataFrame([(1, "Soup")], "id int, title string")
    rows = {r["item_id"]: r for r in inventory.upload_status(reports, names).collect()}
    assert [rows[i]["status"] for i in range(1, 6)] == [L.CRITICAL, L.LOW, L.EXCESS, L.UPLOAD_OK, L.UPLOAD_OK]
    assert rows[1]["item_name"] == "Soup" and rows[2]["item_name"] == "Item 2"
    assert rows[1]["days_of_stock"] == 5.0 and rows[1]["recommended_order_qty"] == 5.0
    assert rows[3]["recommended_order_qty"] == 0.0


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(i, dt.datetime(2024, 1, 1, i), i, float(s), 10.0, 2.0) for i, s in enumerate([5, 5, 5, 5, 5, 5, 5, 100, 100, 100, 40])]
    rows.append((100, dt.datetime(2024, 1, 1, 0), 0, 4.0, 10.0, 2.0))  # same time, higher id: the newer report of item 0
    return spark.createDataFrame(
        rows, "id long, date timestamp, item_id long, current_stock double, reorder_point double, safety_stock double"
    )


@pytest.fixture(scope="module")
def demand(spark):
    return spark.createDataFrame([(1, 1.0), (7, 1.0), (8, 5.0), (10, 2.0)], "item_id long, daily_demand double")


def test_latest_report(reports):
    rows = inventory.latest_report(reports).collect()
    assert len(rows) == 11 and {r["item_id"]: r["id"] for r in rows}[0] == 100


def test_weekly_stock_actions(spark, reports, demand):
    latest = inventory.latest_report(reports)
    names = inventory.item_name_lookup(latest, spark.createDataFrame([(1, "Soup")], "id long, title string"))
    actions = weekly.weekly_stock_actions(latest, demand, names)
    rows = {r["item_id"]: r for r in actions.collect()}
    assert rows[1]["message"] == "Predicted to run out in 5 days based on demand trends. Order 9 units soon."
    assert rows[1]["item"] == "Soup" and rows[2]["item"] == "Item 2"
    assert rows[2]["message"] == "Stock critically low (5). Below reorder point (10)."
    assert rows[7]["kind"] == L.KIND_EXCESS_SLOW and rows[9]["kind"] == L.KIND_EXCESS
    assert 8 not in rows and 10 not in rows  # twenty days of stock
    capped = weekly.weekly_capped_actions(actions).collect()
    assert sum(r["priority"] == "High" for r in capped) == 6 and sum(r["priority"] == "Medium" for r in capped) == 2
    assert [r["message"] for r in capped if r["kind"] == L.KIND_INVENTORY] == [
        "7 items are below reorder point. Review inventory dashboard for full list."
    ]
    assert {r["message"] for r in capped if r["kind"] == L.KIND_RESTOCK} == {"Stock critically low (5). Below reorder point (10)."}


def test_weekly_report(spark, reports, demand):
    names = inventory.item_name_lookup(reports, spark.createDataFrame([], "id long, title string"))
    prices = spark.createDataFrame([(i, 50.0 if i % 2 else 10.0) for i in range(11)], "item_id long, price double")
    edges = spark.createDataFrame([(700.0, 40.0)], "popularity double, profitability double")
    friday = weekly_report(reports, demand, names, prices, edges, dt.date(2024, 1, 5)).collect()
    monday = weekly_report(reports, demand, names, prices, edges, dt.date(2024, 1, 8)).collect()
    assert len(friday) == len(monday) + 1
    order = [L.PRIORITY_RANK[r["priority"]] for r in friday]
    assert order == sorted(order)
    kinds = {r["kind"]: r for r in friday}
    assert kinds[L.KIND_STARS]["item"] == "2 Inventory Items"  # items 1 and 7
    assert kinds[L.KIND_STARS]["message"] == "Top performers identified in your inventory: Item 1, Item 7. Promote them!"
    assert kinds[L.KIND_DOGS]["message"].startswith("Underperforming items identified: Item 0, Item 2, Item 4 and ")


def test_weekly_report_without_uploads(spark):
    alerts = spark.createDataFrame(
        [(i, f"n{i}", s, 3.0, 8.0, 1.9) for i, s in enumerate([L.CRITICAL] * 4 + [L.LOW] * 3 + [L.EXCESS] * 3)],
        "item_id int, item_name string, status string, current_stock double, reorder_point double, days_of_stock double",
    )
    items = spark.createDataFrame([(1, "a", L.STAR), (2, "b", L.DOG)], "item_id int, item_name string, category string")
    rows = weekly_report_without_uploads(alerts, items, dt.date(2024, 1, 8)).collect()
    assert len(rows) == 3 + 2 + 2 + 1 + 2
    assert rows[0]["priority"] == "High" and rows[-1]["priority"] == "Low"
    overview = [r["message"] for r in rows if r["kind"] == L.KIND_OVERVIEW]
    assert overview[0].startswith("4 critical, 3 low stock, 3 excess items")


def test_low_stock_upload_asks_for_action(spark):
    """Stock 5 with reorder point 10 and safety stock 2."""
    report = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 3, 5.0, 10.0, 2.0)],
        "id long, date timestamp, item_id long, current_stock double, reorder_point double, safety_stock double",
    )
    none = spark.createDataFrame([], "item_id long, daily_demand double")
    names = inventory.item_name_lookup(report, spark.createDataFrame([], "id long, title string"))
    row = weekly.weekly_stock_actions(report, none, names).first()
    assert (row["kind"], row["priority"]) == (L.KIND_RESTOCK, "High")


def test_ingredients(spark):
    need = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (9, 5.0)], "item_id int, predicted_demand double")
    parts = spark.createDataFrame([(1, 50, 2.0), (2, 50, 1.0), (2, 51, 4.0)], "parent_sku_id int, sku_id int, quantity double")
    rows = inventory.ingredient_requirements(need, parts).collect()
    assert [tuple(r) for r in rows] == [(50, 11.0, 2), (51, 4.0, 1)]
