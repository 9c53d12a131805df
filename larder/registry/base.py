"""Registration of queries and the SQL views the checks share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.session import configure, shuffles_for
from larder.sources.standins import Standins


#: The named tables that the test tables stand in for: attribute of Standins, and columns in order.
TABLES: dict[str, tuple[str, str]] = {
    "dim_add_ons": ("add_ons", "id, title, price, status"),
    "dim_bill_of_materials": ("bill_of_materials", "parent_sku_id, sku_id, quantity"),
    "dim_campaigns": ("campaigns", "id, title, discount, type, status"),
    "dim_items": ("items", "id, title, price, type, section_id, status, vat"),
    "dim_menu_items": ("menu_items", "id, index, price, rating, votes, purchases"),
    "dim_places": ("places", "id, title, country, area, active"),
    "dim_skus": ("skus", "item_id, quantity, low_stock_threshold"),
    "dim_taxonomy_terms": ("taxonomy", "vocabulary"),
    "dim_users": ("users", "id, orders, cltv, source, country"),
    "fct_cash_balances": ("cash", "place_id, day, opening_balance, closing_balance"),
    "fct_invoice_items": ("invoices", "amount, description"),
    "fct_order_items": ("order_items", "order_id, item_id, menu_item_id, quantity, price, cost, total_cost, discount_amount, commission_amount"),
    "fct_orders": ("orders", "id, place_id, created, total_amount, type, payment_method, source, status"),
    "most_ordered": ("most_ordered", "item_id, place_id, order_count, item_name"),
}


def named_tables(t: Standins) -> dict[str, DataFrame]:
    """Every named table, by name."""
    return {n: getattr(t, a).withColumnRenamed("c_nationkey", "place_id").select(*c.split(", ")) for n, (a, c) in TABLES.items()}


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with its check."""

    def register(fn: Callable[[Standins], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = Standins(configure(spark), sf_dir)
            shuffles_for(spark, t.stored_bytes())
            return fn(t)

        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, with_views(sql) if sql else None)
        return fn

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded half-even, so that the order of a sum does not show."""
    return df.withColumns(
        {c: F.rint(F.col(c).cast("double") * F.lit(10.0**d)) / F.lit(10.0**d) for c, d in digits.items()}
    )


def r(expression: str, digits: int, alias: str | None = None) -> str:
    """The same rounding in SQL."""
    name = alias or expression
    return f"round_even(CAST({expression} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} AS {name}"


VIEWS: dict[str, str] = {
    "fct_orders": """
        SELECT o_orderkey AS id, c_nationkey AS place_id,
               CAST(epoch(o_orderdate) AS BIGINT) + ((o_orderkey % 97) % 24) * 3600 AS created,
               o_totalprice AS total_amount, o_orderpriority AS type,
               CASE WHEN o_orderkey % 3 = 0 THEN 'cash' ELSE 'card' END AS payment_method,
               c_mktsegment AS source, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fct_order_items": """
        SELECT l_orderkey AS order_id, l_partkey AS item_id, l_partkey AS menu_item_id, l_quantity AS quantity,
               l_extendedprice / l_quantity AS price,
               CASE WHEN l_linestatus = 'F' THEN l_extendedprice / l_quantity * 0.6::DOUBLE END AS cost,
               l_extendedprice AS total_cost, l_extendedprice * l_discount AS discount_amount,
               l_extendedprice * l_tax AS commission_amount
        FROM lineitem""",
    "dim_items": """
        SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title, p_retailprice AS price, p_type AS type,
               p_size AS section_id, CASE WHEN p_size % 5 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
               25.0::DOUBLE AS vat
        FROM part""",
    "most_ordered": """
        SELECT place_id, item_id, title AS item_name, count(DISTINCT order_id) AS order_count
        FROM fct_order_items JOIN fct_orders o ON order_id = o.id JOIN dim_items i ON item_id = i.id
        GROUP BY place_id, item_id, title""",
    "dim_menu_items": """
        SELECT p_partkey AS id, p_partkey AS index, p_retailprice AS price,
               3.0::DOUBLE + (p_partkey % 21) / 10.0::DOUBLE AS rating, p_partkey % 100 AS votes,
               coalesce(n, 0) AS purchases
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""",
    "dim_places": """
        SELECT n_nationkey AS id, n_name AS title, r_name AS country, r_name AS area,
               CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END AS active
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dim_users": """
        SELECT c_custkey AS id, coalesce(n, 0) AS orders, coalesce(spent, 0) AS cltv, c_mktsegment AS source,
               n_name AS country
        FROM customer
        LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
          ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "dim_campaigns": """
        SELECT s_suppkey AS id, s_name AS title, d * 100 AS discount, n_name AS type,
               CASE WHEN s_acctbal > 0 THEN 'Active' ELSE 'Expired' END AS status
        FROM supplier JOIN (SELECT l_suppkey, avg(l_discount) AS d FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "dim_add_ons": """
        SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size = 1 THEN 0 ELSE p_retailprice END AS price,
               CASE WHEN p_size % 5 = 0 THEN 'Inactive' ELSE 'Active' END AS status
        FROM part WHERE p_size <= 10""",
    "fct_invoice_items": "SELECT l_extendedprice AS amount, l_returnflag AS description FROM lineitem",
    "fct_cash_balances": """
        SELECT c_nationkey AS place_id, CAST(o_orderdate AS DATE) AS day, min(o_totalprice) AS opening_balance,
               max(o_totalprice) AS closing_balance
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "dim_taxonomy_terms": "SELECT p_brand AS vocabulary FROM part",
    "dim_bill_of_materials": """
        SELECT p_partkey AS parent_sku_id, CAST(p_size AS BIGINT) AS sku_id, 1 + p_partkey % 3 AS quantity FROM part
        UNION ALL SELECT p_partkey, 100 + p_partkey % 25, 1 + p_partkey % 3 FROM part""",
    "current_inventory": "SELECT p_partkey AS item_id, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS current_stock FROM part",
    "inventory_reports": """
        SELECT p_partkey * 10 + copy AS id, TIMESTAMP '2024-01-01 00:00:00' + copy * INTERVAL 1 DAY AS date,
               p_partkey AS item_id, CAST((p_partkey * 37) % 1000 AS DOUBLE) * factor AS current_stock,
               CAST(20 + p_size AS DOUBLE) AS reorder_point, CAST(20 + p_size AS DOUBLE) * 0.5::DOUBLE AS safety_stock
        FROM part, (VALUES (1, 1.0::DOUBLE), (2, 0.5::DOUBLE), (3, 0.1::DOUBLE)) AS t(copy, factor)""",
    "dim_skus": """
        SELECT CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE CAST(p_partkey AS VARCHAR) END AS item_id,
               CAST((p_partkey * 37) % 1000 AS DOUBLE) AS quantity, CAST(20 + p_size AS DOUBLE) AS low_stock_threshold
        FROM part""",
    "order_messages": """
        SELECT CAST(event_id AS VARCHAR) AS order_id, user_id % 25 AS restaurant_id, value AS total_amount, event_id, ts
        FROM events WHERE event_type = 'purchase'""",
    "live_order_items": """
        SELECT order_id, 0 AS line_no, (event_id * 7 + 1) % 200 AS menu_item_id, 1 + event_id % 3 AS quantity,
               total_amount * CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS price_at_time
        FROM order_messages
        UNION ALL
        SELECT order_id, 1, (event_id * 7 + 2) % 200, 1 + event_id % 2, total_amount * 0.25::DOUBLE
        FROM order_messages WHERE event_id % 2 = 0""",
    "timed_orders": """
        SELECT *, make_timestamp(created * 1000000) AS placed, CAST(make_timestamp(created * 1000000) AS DATE) AS order_date,
               CAST(hour(make_timestamp(created * 1000000)) AS INTEGER) AS hour,
               CAST(isodow(make_timestamp(created * 1000000)) - 1 AS INTEGER) AS day_of_week,
               dayname(make_timestamp(created * 1000000)) AS day_name,
               CAST(month(make_timestamp(created * 1000000)) AS INTEGER) AS month,
               CAST(weekofyear(make_timestamp(created * 1000000)) AS INTEGER) AS week_of_year,
               CASE WHEN isodow(make_timestamp(created * 1000000)) >= 6 THEN 1 ELSE 0 END AS is_weekend
        FROM fct_orders""",
    "order_lines": """
        SELECT l.*, o.place_id, o.placed, o.order_date, o.hour, o.day_of_week, o.day_name, o.month, o.week_of_year, o.is_weekend
        FROM fct_order_items l JOIN timed_orders o ON l.order_id = o.id""",
    "daily_demand": """
        SELECT place_id, item_id, order_date AS date, sum(quantity) AS quantity_demanded, avg(price) AS avg_price,
               avg(cost) AS avg_cost, count(DISTINCT order_id) AS num_orders, min(day_of_week) AS day_of_week,
               min(month) AS month, min(week_of_year) AS week_of_year, min(is_weekend) AS is_weekend
        FROM order_lines GROUP BY 1, 2, 3""",
    "item_stats": """
        SELECT item_id, sum(quantity) AS total_qty, avg(quantity) AS avg_daily_qty,
               coalesce(stddev_samp(quantity), 0) AS std_daily_qty, avg(price) AS avg_price,
               count(DISTINCT order_id) AS total_orders
        FROM order_lines GROUP BY item_id""",
    "place_stats": """
        SELECT place_id, count(DISTINCT order_id) AS total_orders, sum(quantity) AS total_qty, avg(price) AS avg_order_value
        FROM order_lines GROUP BY place_id""",
    "enriched": """
        SELECT d.*, i.avg_daily_qty, i.std_daily_qty, i.total_orders, p.total_orders AS total_orders_restaurant,
               p.avg_order_value
        FROM daily_demand d LEFT JOIN item_stats i USING (item_id) LEFT JOIN place_stats p USING (place_id)""",
    "lagged": """
        SELECT *,
               coalesce(avg(quantity_demanded) OVER (PARTITION BY item_id, place_id ORDER BY date
                        ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), avg_daily_qty) AS lag_7d_avg,
               coalesce(avg(quantity_demanded) OVER (PARTITION BY item_id, place_id ORDER BY date
                        ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), avg_daily_qty) AS lag_14d_avg
        FROM enriched""",
    "item_performance": """
        SELECT item_id, item_name, CAST(sum(order_count) AS BIGINT) AS order_count, avg(price) AS price,
               sum(price * order_count) AS revenue
        FROM most_ordered JOIN dim_items ON item_id = id WHERE price > 0 AND order_count > 0
        GROUP BY item_id, item_name""",
    "live_performance": """
        SELECT s.item_id, order_count, revenue, title AS item_name, price, type AS category, CAST(NULL AS VARCHAR) AS description,
               s.item_id % 25 AS restaurant_id
        FROM (SELECT menu_item_id AS item_id, CAST(sum(quantity) AS BIGINT) AS order_count,
                     sum(quantity * price_at_time) AS revenue
              FROM live_order_items GROUP BY 1) s
        LEFT JOIN dim_items ON s.item_id = id""",
    # ---- fixed values: the labels and message texts in the views below are those of larder/functions/labels.py ----
    "thresholds": """
        SELECT quantile_cont(CAST(order_count AS DOUBLE), 0.5) AS popularity, quantile_cont(price, 0.5) AS profitability
        FROM item_performance""",
    "classified": """
        SELECT p.*,
               CASE WHEN order_count >= popularity AND price >= profitability THEN '⭐ Star'
                    WHEN order_count >= popularity THEN '🐴 Plowhorse'
                    WHEN price >= profitability THEN '❓ Puzzle' ELSE '🐕 Dog' END AS category
        FROM item_performance p, thresholds""",
    "category_actions": """
        SELECT * FROM (VALUES
          ('⭐ Star', 'Promote heavily, protect margins, feature prominently', 1, '+15% visibility'),
          ('🐴 Plowhorse', 'Consider 10-15% price increase, bundle with lower-margin items', 2, '+10% margin'),
          ('❓ Puzzle', 'Increase visibility, improve descriptions, run promotions', 3, '+20% orders'),
          ('🐕 Dog', 'Re-engineer, bundle with stars, or remove from menu', 4, '-25% waste')
        ) AS t(category, action, priority, expected_impact)""",
    "suggestions": """
        SELECT item_id, item_name, order_count, price, round_even(price * 1.12::DOUBLE, 2) AS suggested_price, revenue,
               round_even(price * 1.12::DOUBLE, 2) * order_count AS potential_revenue,
               round_even(price * 1.12::DOUBLE, 2) * order_count - revenue AS revenue_gain
        FROM classified WHERE category = '🐴 Plowhorse'""",
    "demand_stats": """
        SELECT item_id, avg(quantity_demanded) AS avg_daily_demand,
               coalesce(stddev_samp(quantity_demanded), avg(quantity_demanded) * 0.2::DOUBLE) AS demand_std,
               sum(quantity_demanded) AS total_demand, count(*) AS days_with_demand, avg(avg_price) AS avg_price
        FROM daily_demand GROUP BY item_id""",
    "policy": """
        SELECT *, round_even(avg_daily_demand * 2.0::DOUBLE + safety_stock, 0) AS reorder_point,
               round_even(sqrt(2 * avg_daily_demand * 365 * 50 / CASE WHEN avg_price = 0 THEN 1 ELSE avg_price * 0.2::DOUBLE END), 0) AS eoq
        FROM (SELECT *, round_even(1.6448536269514722::DOUBLE * demand_std * sqrt(2.0::DOUBLE), 0) AS safety_stock
              FROM demand_stats)""",
    "analysis": """
        SELECT *,
               CASE WHEN current_stock <= 0 OR current_stock < safety_stock THEN '🔴 Critical - Stockout Risk'
                    WHEN current_stock < reorder_point THEN '🟠 Low - Reorder Soon'
                    WHEN days > 30 THEN '🔵 Excess - Overstock Risk'
                    WHEN days > 14 THEN '🟡 High - Monitor' ELSE '🟢 Optimal' END AS status,
               CASE WHEN avg_daily_demand > 0 THEN round_even(days, 1) ELSE 999 END AS days_of_stock,
               CASE WHEN current_stock < reorder_point
                    THEN round_even(greatest(0, eoq - current_stock + safety_stock), 0) ELSE 0 END AS recommended_order_qty
        FROM (SELECT p.*, title AS item_name, coalesce(c.current_stock, 0) AS current_stock,
                     CASE WHEN avg_daily_demand > 0 THEN coalesce(c.current_stock, 0) / avg_daily_demand
                          ELSE CAST('infinity' AS DOUBLE) END AS days
              FROM policy p LEFT JOIN dim_items i ON p.item_id = i.id LEFT JOIN current_inventory c ON p.item_id = c.item_id)""",
    "alerts": """
        SELECT * FROM analysis WHERE status LIKE '%Critical%' OR status LIKE '%Low -%' OR status LIKE '%Excess%'""",
    "latest_reports": """
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC, id DESC) AS rn FROM inventory_reports)
        WHERE rn = 1""",
    "given_demand": "SELECT item_id, total_demand / 730 AS daily_demand, avg_price AS price FROM demand_stats",
    "stock_actions": """
        SELECT r.item_id, r.id, r.date, title AS item, current_stock AS s, reorder_point AS ro, coalesce(daily_demand, 0) AS d,
               CASE WHEN coalesce(daily_demand, 0) > 0 THEN current_stock / daily_demand ELSE 999 END AS days
        FROM latest_reports r LEFT JOIN given_demand g USING (item_id) LEFT JOIN dim_items i ON r.item_id = i.id""",
    "stock_messages": """
        SELECT item_id, id, date, item,
               CASE WHEN d > 0 AND days < 7 THEN '📉 High Demand Alert (ML)'
                    WHEN s < ro THEN '🔴 Restock Alert'
                    WHEN s > ro * 3 AND d > 0 AND days > 60 THEN '📦 Excess Stock (Slow Moving)'
                    WHEN s > ro * 3 AND d = 0 THEN '📦 Excess Stock' END AS kind,
               CASE WHEN d > 0 AND days < 7 THEN printf('Predicted to run out in %d days based on demand trends. Order %d units soon.',
                         CAST(trunc(days) AS BIGINT), CAST(trunc(d * 14 - s) AS BIGINT))
                    WHEN s < ro THEN printf('Stock critically low (%d). Below reorder point (%d).', CAST(trunc(s) AS BIGINT), CAST(trunc(ro) AS BIGINT))
                    WHEN s > ro * 3 AND d > 0 AND days > 60 THEN printf('High inventory (%d) with low predicted demand. >60 days supply. Run a promotion.', CAST(trunc(s) AS BIGINT))
                    ELSE printf('Overstocked (%d units). Consider running a promotion.', CAST(trunc(s) AS BIGINT)) END AS message,
               CASE WHEN (d > 0 AND days < 7) OR s < ro THEN 'High' ELSE 'Medium' END AS priority,
               CASE WHEN (d > 0 AND days < 7) OR s < ro THEN 'low' ELSE 'excess' END AS shelf
        FROM stock_actions""",
    "kept_stock_messages": "SELECT * FROM stock_messages WHERE kind IS NOT NULL",
    "capped_actions": """
        SELECT kind, item, message, priority FROM (
          SELECT *, row_number() OVER (PARTITION BY shelf ORDER BY date DESC, item_id DESC) AS rn FROM kept_stock_messages)
        WHERE rn <= CASE WHEN shelf = 'low' THEN 5 ELSE 2 END
        UNION ALL
        SELECT '⚠️ Inventory Alert', 'Multiple Items',
               printf('%d items are below reorder point. Review inventory dashboard for full list.', count(*)), 'High'
        FROM kept_stock_messages WHERE shelf = 'low' HAVING count(*) > 3""",
    "named_menu_actions": """
        SELECT CASE category WHEN '⭐ Star' THEN '⭐ Star Performers (ML)' WHEN '🐕 Dog' THEN '🐕 Menu Optimization (ML)'
                             WHEN '❓ Puzzle' THEN '💡 Growth Opportunity (ML)' ELSE '💰 Cost Optimization (ML)' END AS kind,
               printf('%d Inventory Items', n) AS item,
               CASE category
                 WHEN '⭐ Star' THEN 'Top performers identified in your inventory: ' || names || '. Promote them!'
                 WHEN '🐕 Dog' THEN 'Underperforming items identified: ' || names || '. Consider removing or Bundle deals.'
                 WHEN '❓ Puzzle' THEN 'Profitable but low volume items found. Increase visibility to boost sales.'
                 ELSE 'High volume but low margin items found. Consider small price increase.' END AS message,
               CASE WHEN category IN ('🐕 Dog', '❓ Puzzle') THEN 'Medium' ELSE 'Low' END AS priority
        FROM (SELECT category, count(*) AS n,
                     string_agg(item_name, ', ' ORDER BY item_id, item_name) FILTER (WHERE rn <= 3)
                     || CASE WHEN count(*) > 3 THEN printf(' and %d others', count(*) - 3) ELSE '' END AS names
              FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id, item_name) AS rn FROM classified)
              GROUP BY category)""",
    "alert_totals": """
        SELECT count(*) FILTER (WHERE status LIKE '%Critical%') AS critical_items,
               count(*) FILTER (WHERE status LIKE '%Low%') AS low_stock_items,
               count(*) FILTER (WHERE status LIKE '%Excess%') AS excess_items FROM alerts""",
    "alert_actions": """
        SELECT CASE WHEN status LIKE '%Critical%' THEN '🔴 Critical Stock (ML Analysis)'
                    WHEN status LIKE '%Low -%' THEN '🟠 Low Stock (ML Analysis)' ELSE '📦 Excess Stock (ML Analysis)' END AS kind,
               item_name AS item,
               CASE WHEN status LIKE '%Critical%' THEN printf('Only %d units left (~%d days of stock). Reorder immediately.',
                         CAST(trunc(current_stock) AS BIGINT), CAST(trunc(days_of_stock) AS BIGINT))
                    WHEN status LIKE '%Low -%' THEN printf('Stock at %d units, approaching reorder point (%d). Plan reorder soon.',
                         CAST(trunc(current_stock) AS BIGINT), CAST(trunc(reorder_point) AS BIGINT))
                    ELSE printf('Overstocked with %d units (~%d days supply). Consider a promotion.',
                         CAST(trunc(current_stock) AS BIGINT), CAST(trunc(days_of_stock) AS BIGINT)) END AS message,
               CASE WHEN status LIKE '%Critical%' THEN 'High' ELSE 'Medium' END AS priority
        FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY item_id) AS rn FROM alerts)
        WHERE rn <= CASE WHEN status LIKE '%Critical%' THEN 3 ELSE 2 END
        UNION ALL
        SELECT '⚠️ Inventory Overview', 'All Items',
               printf('%d critical, %d low stock, %d excess items detected from ML demand analysis. Upload your CSV for live tracking.',
                      critical_items, low_stock_items, excess_items), 'High'
        FROM alert_totals WHERE critical_items + low_stock_items + excess_items > 0""",
    "line_totals": """
        SELECT order_id, count(*) AS lines, count(DISTINCT item_id) AS unique_items, sum(quantity) AS quantity
        FROM fct_order_items GROUP BY order_id""",
}


def with_views(sql: str) -> str:
    """The statement with the views it uses, directly or through others, as a WITH clause."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    own = sql.strip()
    if own[:4].upper() == "WITH":
        return f"WITH {parts},\n{own[4:].strip()}"
    return f"WITH {parts}\n{own}"
