"""Validity in time, snapshot differences and totals over several keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.scalars import event_time
from larder.operators import changes, rollups, validity
from larder.registry.base import query, r, rounded
from larder.session import written

# Dated campaigns and prices derived from suppliers and parts; every fifth campaign is open for ever.
CAMPAIGNS = """
    campaigns AS (SELECT s_suppkey AS campaign_id, s_nationkey AS place_id, 5 + s_suppkey % 20 AS discount,
                         TIMESTAMP '1993-01-01 00:00:00' + to_days(CAST(s_suppkey * 37 % 1800 AS INTEGER)) AS starts,
                         CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '1993-01-01 00:00:00' + to_days(CAST(s_suppkey * 37 % 1800 + 10 + s_suppkey % 200 AS INTEGER)) END AS ends
                  FROM supplier)"""
PRICES = """
    prices AS (SELECT p_partkey AS item_id, TIMESTAMP '1992-02-01 00:00:00' + to_days(CAST(v * 500 + p_partkey % 100 AS INTEGER)) AS since,
                      p_retailprice * (1 + 0.1::DOUBLE * v) AS list_price
               FROM part, (VALUES (0), (1), (2), (3)) AS t(v))"""


def campaigns(t):
    begin = F.lit("1993-01-01 00:00:00").cast("timestamp")
    days = F.col("s_suppkey") * 37 % 1800
    day = lambda n: begin + F.make_dt_interval(n)
    return t.raw("supplier").select(
        F.col("s_suppkey").alias("campaign_id"), F.col("s_nationkey").alias("place_id"), (5 + F.col("s_suppkey") % 20).alias("discount"),
        day(days).alias("starts"), F.when(F.col("s_suppkey") % 5 != 0, day(days + 10 + F.col("s_suppkey") % 200)).alias("ends"),
    )


def prices(t):
    begin = F.lit("1992-02-01 00:00:00").cast("timestamp")
    versions = F.explode(F.array(*[F.lit(v) for v in range(4)])).alias("v")
    return t.raw("part").select("p_partkey", "p_retailprice", versions).select(
        F.col("p_partkey").alias("item_id"), (begin + F.make_dt_interval(F.col("v") * 500 + F.col("p_partkey") % 100)).alias("since"),
        (F.col("p_retailprice") * (1 + F.lit(0.1) * F.col("v"))).alias("list_price"),
    )


def placed_orders(t):
    return t.orders.withColumn("placed", event_time("created"))


@query(
    "va1_campaign_at_order",
    f"""WITH {CAMPAIGNS},
        met AS (SELECT o.id, c.campaign_id, c.discount FROM timed_orders o JOIN campaigns c
                ON o.place_id = c.place_id AND c.starts <= o.placed AND (c.ends IS NULL OR o.placed < c.ends)),
        best AS (SELECT id, count(*) AS campaigns, arg_max(campaign_id, discount * 1000000 - campaign_id) AS campaign_id,
                        max(discount) AS discount FROM met GROUP BY id)
        SELECT o.id, o.place_id, coalesce(b.campaigns, 0) AS campaigns, b.campaign_id, b.discount
        FROM timed_orders o LEFT JOIN best b ON o.id = b.id""",
)
def va1(t):
    return validity.campaign_at_order(placed_orders(t), campaigns(t))


@query(
    "va2_price_at_order",
    f"""WITH {PRICES},
        placed AS (SELECT l.order_id, l.item_id, l.quantity, l.price, o.placed FROM fct_order_items l JOIN timed_orders o ON l.order_id = o.id)
        SELECT p.order_id, p.item_id, p.quantity, {r('p.price', 4, 'price')}, {r('s.list_price', 4, 'list_price')},
               {r('(s.list_price - p.price) * p.quantity', 2, 'given_away')}
        FROM placed p ASOF LEFT JOIN prices s ON p.item_id = s.item_id AND p.placed >= s.since""",
)
def va2(t):
    found = validity.price_at_order(t.order_items, placed_orders(t), prices(t)).drop("placed", "since")
    return rounded(found, price=4, list_price=4, given_away=2)


# Two menu snapshots: items removed, added, repriced, renamed, and some that stand twice in the older one.
OLD_MENU = """
    old_menu AS (SELECT id, title, price, status FROM dim_items UNION ALL SELECT id, title, price, status FROM dim_items WHERE id % 7 = 0)"""
NEW_MENU = """
    new_menu AS (SELECT id, CASE WHEN id % 31 <> 0 THEN title END AS title, CASE WHEN id % 5 = 0 THEN price + 1 ELSE price END AS price, status
                 FROM dim_items WHERE id % 17 <> 0
                 UNION ALL SELECT CASE WHEN id % 2 = 0 THEN id + 1000000 END, title, price, 'New' FROM dim_items WHERE id % 97 = 0)"""


def old_menu(t):
    menu = t.items.select("id", "title", "price", "status")
    return menu.unionByName(menu.where("id % 7 = 0"))


def new_menu(t):
    menu = t.items.select("id", "title", "price", "status")
    kept = menu.where("id % 17 <> 0").withColumns(
        {"title": F.when(F.col("id") % 31 != 0, F.col("title")), "price": F.when(F.col("id") % 5 == 0, F.col("price") + 1).otherwise(F.col("price"))}
    )
    more = menu.where("id % 97 = 0").withColumns({"id": F.when(F.col("id") % 2 == 0, F.col("id") + 1_000_000), "status": F.lit("New")})
    return kept.unionByName(more)


@query(
    "ch1_row_changes",
    f"""WITH {OLD_MENU}, {NEW_MENU}
        SELECT 'added' AS change, * FROM (SELECT * FROM new_menu EXCEPT ALL SELECT * FROM old_menu)
        UNION ALL SELECT 'removed', * FROM (SELECT * FROM old_menu EXCEPT ALL SELECT * FROM new_menu)""",
)
def ch1(t):
    return changes.row_changes(old_menu(t), new_menu(t))


@query("ch2_apply_changes", f"WITH {NEW_MENU} SELECT * FROM new_menu")
def ch2(t):
    return changes.apply_changes(old_menu(t), changes.row_changes(old_menu(t), new_menu(t)))


@query("ch3_unchanged_rows", f"WITH {OLD_MENU}, {NEW_MENU} SELECT * FROM old_menu INTERSECT ALL SELECT * FROM new_menu")
def ch3(t):
    return changes.unchanged_rows(old_menu(t), new_menu(t))


@query(
    "ch4_field_changes",
    f"""WITH {OLD_MENU}, {NEW_MENU},
        o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title NULLS FIRST, price NULLS FIRST, status NULLS FIRST) AS copy FROM old_menu),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title NULLS FIRST, price NULLS FIRST, status NULLS FIRST) AS copy FROM new_menu),
        j AS (SELECT o.id AS oid, n.id AS nid, coalesce(o.copy, n.copy) AS copy, o.copy IS NULL AS came, n.copy IS NULL AS gone,
                     list_filter([CASE WHEN o.title IS DISTINCT FROM n.title THEN 'title' END, CASE WHEN o.price IS DISTINCT FROM n.price THEN 'price' END,
                                  CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END], lambda x: x IS NOT NULL) AS fields,
                     o.title AS before_title, n.title AS after_title
              FROM o FULL JOIN n ON o.id IS NOT DISTINCT FROM n.id AND o.copy = n.copy)
        SELECT CASE WHEN came THEN nid ELSE oid END AS id, CAST(copy AS INTEGER) AS copy, CASE WHEN came THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change,
               array_to_string(fields, ',') AS fields,
               CASE WHEN list_contains(fields, 'title') THEN before_title END AS before_title,
               CASE WHEN list_contains(fields, 'title') THEN after_title END AS after_title
        FROM j WHERE came OR gone OR len(fields) > 0""",
)
def ch4(t):
    found = changes.field_changes(old_menu(t), new_menu(t), ["id"])
    value = lambda c: F.col(c).getItem("title").alias(f"{c}_title")
    return found.select("id", "copy", "change", F.array_join("fields", ",").alias("fields"), value("before"), value("after"))


SALES = """
    sales AS (SELECT o.place_id, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS category, CAST(date_trunc('month', o.order_date) AS DATE) AS month,
                     l.order_id, l.total_cost, l.quantity
              FROM fct_order_items l JOIN timed_orders o ON l.order_id = o.id JOIN part ON p_partkey = l.item_id)"""
TOTALS = f"""grouping(place_id) AS all_place_id, grouping(category) AS all_category, grouping(month) AS all_month,
             {r('sum(total_cost)', 2, 'revenue')}, sum(quantity) AS quantity, count(DISTINCT order_id) AS orders"""


def cells(t):
    items = t.raw("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("category"))
    return rollups.sales_cells(t.order_items, t.orders, items)


def _sales(name, clause):
    return f"""WITH {SALES} SELECT place_id, category, month, CAST(all_place_id AS INTEGER) AS all_place_id, CAST(all_category AS INTEGER) AS all_category,
                      CAST(all_month AS INTEGER) AS all_month, revenue, quantity, orders
               FROM (SELECT place_id, category, month, {TOTALS} FROM sales GROUP BY {clause})"""


@query("gs1_sales_cube", _sales("cube", "CUBE (place_id, category, month)"))
def gs1(t):
    return rounded(rollups.sales_cube(cells(t)), revenue=2)


@query("gs2_sales_rollup", _sales("rollup", "ROLLUP (place_id, category, month)"))
def gs2(t):
    return rounded(rollups.sales_rollup(cells(t)), revenue=2)


@query("gs3_sales_sets", _sales("sets", "GROUPING SETS ((place_id, month), (category), ())"))
def gs3(t):
    return rounded(rollups.sales_sets(written(cells(t), "cells"), [("place_id", "month"), ("category",), ()]), revenue=2)
