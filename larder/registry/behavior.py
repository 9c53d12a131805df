"""Order behaviour and dashboard."""

from __future__ import annotations

from larder.functions.scalars import flatten_record
from larder.operators import behavior, dashboard, inventory
from larder.plans import stock
from larder.registry.base import query, r, rounded


def facts(t):
    return behavior.order_facts(t.order_items, t.orders)


def alert_totals(t):
    return inventory.alert_counts(stock.restock_list(t.order_items, t.orders, t.items, t.current_inventory))


@query(
    "cb1_hourly_pattern",
    f"""SELECT hour, count(DISTINCT order_id) AS num_orders, sum(quantity) AS total_quantity,
               {r('sum(price)', 2, 'total_revenue')} FROM order_lines GROUP BY hour""",
)
def cb1(t):
    return rounded(behavior.hourly_pattern(facts(t)), total_revenue=2)


@query(
    "cb2_weekday_pattern",
    "SELECT day_name, count(DISTINCT order_id) AS num_orders, sum(quantity) AS total_quantity FROM order_lines GROUP BY day_name",
)
def cb2(t):
    return behavior.weekday_pattern(facts(t))


@query(
    "cb3_monthly_pattern",
    "SELECT month, count(DISTINCT order_id) AS num_orders, sum(quantity) AS total_quantity FROM order_lines GROUP BY month",
)
def cb3(t):
    return behavior.monthly_pattern(facts(t))


INSIGHTS_SQL = f"""
    SELECT (SELECT hour FROM order_lines GROUP BY hour ORDER BY count(DISTINCT order_id) DESC, hour LIMIT 1) AS peak_hour,
           (SELECT printf('%02d:00', hour) FROM order_lines GROUP BY hour
            ORDER BY count(DISTINCT order_id) DESC, hour LIMIT 1) AS peak_hour_label,
           (SELECT day_name FROM order_lines GROUP BY day_name, day_of_week
            ORDER BY count(DISTINCT order_id) DESC, day_of_week LIMIT 1) AS peak_day,
           (SELECT round_even(count(DISTINCT order_id) FILTER (WHERE is_weekend = 1) * 100.0::DOUBLE
                   / (count(DISTINCT order_id) FILTER (WHERE is_weekend = 1)
                      + count(DISTINCT order_id) FILTER (WHERE is_weekend = 0)), 1) FROM order_lines) AS weekend_pct,
           (SELECT round_even(count(DISTINCT id)::DOUBLE / count(DISTINCT order_date), 1) FROM timed_orders) AS avg_orders_per_day"""


@query("cb4_temporal_insights", INSIGHTS_SQL)
def cb4(t):
    return behavior.temporal_insights(facts(t), t.orders)


BASKETS_SQL = f"""
    SELECT {r('avg(unique_items)', 1, 'avg_items_per_order')}, {r('avg(quantity)', 1, 'avg_quantity_per_order')},
           {r('avg(total_amount)', 2, 'avg_order_value')},
           {r('quantile_cont(total_amount, 0.5)', 2, 'median_order_value')}
    FROM line_totals JOIN fct_orders ON order_id = id"""


@query("cb5_basket_stats", BASKETS_SQL)
def cb5(t):
    return behavior.basket_stats(t.order_items, t.orders)


@query(
    "cb6_top_items",
    f"""SELECT item_id, sum(quantity) AS total_qty, count(DISTINCT order_id) AS num_orders,
               {r('avg(price)', 4, 'avg_price')}
        FROM fct_order_items GROUP BY item_id ORDER BY total_qty DESC, item_id LIMIT 20""",
)
def cb6(t):
    return rounded(behavior.top_items(t.order_items), avg_price=4)


@query("cb7_order_type_counts", "SELECT type, count(*) AS orders FROM fct_orders GROUP BY type")
def cb7(t):
    return behavior.order_type_counts(t.orders)


@query(
    "cb8_co_purchased_items",
    f"""WITH baskets AS (SELECT DISTINCT order_id, item_id FROM fct_order_items),
             n AS (SELECT count(DISTINCT order_id) AS total FROM baskets),
             f AS (SELECT item_id, count(*) AS c FROM baskets GROUP BY item_id),
             p AS (SELECT a.item_id AS item_1, b.item_id AS item_2, count(*) AS co_purchase_count
                   FROM baskets a JOIN baskets b ON a.order_id = b.order_id AND a.item_id < b.item_id GROUP BY 1, 2)
        SELECT item_1, item_2, co_purchase_count, {r('co_purchase_count / total', 8, 'support')},
               {r('(co_purchase_count / total) / ((x.c / total) * (y.c / total))', 4, 'lift')}
        FROM p, n, f x, f y
        WHERE x.item_id = item_1 AND y.item_id = item_2 AND co_purchase_count / total >= 0.0001::DOUBLE
        ORDER BY co_purchase_count DESC, item_1, item_2 LIMIT 50""",
)
def cb8(t):
    return rounded(behavior.co_purchased_items(t.order_items, min_support=0.0001), support=8, lift=4)


@query(
    "cb9_restaurant_performance",
    f"""WITH h AS (SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice / l_quantity AS price, c_nationkey AS place_id,
                          CAST((o_orderkey % 97) % 24 AS INTEGER) AS hour
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
             m AS (SELECT place_id, hour, row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC, hour) AS rn
                   FROM h GROUP BY place_id, hour)
        SELECT h.place_id, count(DISTINCT l_orderkey) AS total_orders, sum(l_quantity) AS total_quantity,
               {r('sum(price)', 2, 'total_revenue')}, count(DISTINCT l_partkey) AS unique_items_sold,
               any_value(m.hour) AS peak_hour,
               {r('sum(price) / count(DISTINCT l_orderkey)', 2, 'avg_order_value')},
               {r('count(DISTINCT l_partkey) / count(DISTINCT l_orderkey)', 2, 'items_per_order')}
        FROM h JOIN m ON h.place_id = m.place_id AND rn = 1 GROUP BY h.place_id""",
)
def cb9(t):
    return rounded(behavior.restaurant_performance(t.order_items, t.orders), total_revenue=2)


@query(
    "cb10_behavior_coverage",
    """SELECT (SELECT count(*) FROM fct_orders) AS total_orders, count(*) AS total_order_items,
              count(DISTINCT item_id) AS unique_items,
              (SELECT count(DISTINCT place_id) FROM order_lines) AS unique_restaurants FROM fct_order_items""",
)
def cb10(t):
    return behavior.behavior_coverage(t.order_items, t.orders)


@query(
    "db1_dashboard_hourly",
    """WITH o AS (SELECT hour, count(*) AS orders, CAST(trunc(sum(total_amount)) AS BIGINT) AS revenue FROM timed_orders GROUP BY hour),
            q AS (SELECT hour, CAST(trunc(sum(quantity)) AS BIGINT) AS quantity FROM order_lines GROUP BY hour)
       SELECT CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END || CASE WHEN hour < 12 THEN 'am' ELSE 'pm' END AS hour,
              orders, coalesce(quantity, 0) AS quantity, revenue FROM o LEFT JOIN q USING (hour)""",
)
def db1(t):
    return dashboard.dashboard_hourly(t.orders, t.order_items)


@query(
    "db2_order_value_stats",
    f"SELECT {r('avg(total_amount)', 2, 'avg_order_value')}, {r('quantile_cont(total_amount, 0.5)', 2, 'median_order_value')} FROM fct_orders",
)
def db2(t):
    return dashboard.order_value_stats(t.orders)


@query(
    "db3_lines_per_order",
    f"SELECT {r('avg(lines)', 2, 'avg_items_per_order')}, {r('avg(quantity)', 2, 'avg_quantity_per_order')} FROM line_totals",
)
def db3(t):
    return dashboard.lines_per_order(t.order_items)


@query(
    "db4_orders_per_day",
    f"SELECT {r('count(*) / greatest(floor((max(created) - min(created)) / 86400), 1)', 1, 'avg_orders_per_day')} FROM fct_orders",
)
def db4(t):
    return dashboard.orders_per_day(t.orders)


PEAK_SQL = """
    SELECT (SELECT hour FROM timed_orders GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour,
           (SELECT hour || ':00' FROM timed_orders GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour_label,
           (SELECT day_name FROM timed_orders GROUP BY day_name ORDER BY count(*) DESC, day_name LIMIT 1) AS peak_day,
           (SELECT round_even(avg(is_weekend) * 100, 1) FROM timed_orders) AS weekend_pct"""


@query("db5_peak_by_mode", PEAK_SQL)
def db5(t):
    return dashboard.peak_by_mode(t.orders)


@query(
    "db6_dashboard_summary",
    f"""SELECT (SELECT count(*) FROM fct_orders) AS total_orders, (SELECT count(*) FROM fct_order_items) AS total_order_items,
               (SELECT count(DISTINCT place_id) FROM fct_orders) AS restaurants, (SELECT count(*) FROM dim_items) AS menu_items,
               p.*,
               (SELECT round_even(count(*) / greatest(floor((max(created) - min(created)) / 86400), 1), 1) FROM fct_orders) AS avg_orders_per_day,
               (SELECT round_even(avg(lines), 2) FROM line_totals) AS avg_items_per_order,
               (SELECT round_even(avg(quantity), 2) FROM line_totals) AS avg_quantity_per_order,
               (SELECT round_even(avg(total_amount), 2) FROM fct_orders) AS avg_order_value,
               (SELECT round_even(quantile_cont(total_amount, 0.5), 2) FROM fct_orders) AS median_order_value,
               a.*
        FROM ({PEAK_SQL}) p, alert_totals a""",
)
def db6(t):
    return dashboard.dashboard_summary(t.orders, t.order_items, t.items, alert_totals(t))


@query(
    "ex1_inventory_summary",
    f"""SELECT (SELECT count(*) FROM fct_orders) AS data_overview_total_orders,
               (SELECT count(*) FROM fct_order_items) AS data_overview_total_order_items,
               (SELECT count(DISTINCT place_id) FROM fct_orders) AS data_overview_restaurants,
               (SELECT count(*) FROM dim_items) AS data_overview_menu_items,
               i.peak_hour AS customer_behavior_peak_hour, i.peak_hour_label AS customer_behavior_peak_hour_label,
               i.peak_day AS customer_behavior_peak_day, i.weekend_pct AS customer_behavior_weekend_pct,
               i.avg_orders_per_day AS customer_behavior_avg_orders_per_day,
               b.avg_items_per_order AS purchase_patterns_avg_items_per_order,
               b.avg_quantity_per_order AS purchase_patterns_avg_quantity_per_order,
               b.avg_order_value AS purchase_patterns_avg_order_value,
               b.median_order_value AS purchase_patterns_median_order_value,
               a.critical_items AS inventory_alerts_critical_items, a.low_stock_items AS inventory_alerts_low_stock_items,
               a.excess_items AS inventory_alerts_excess_items
        FROM ({INSIGHTS_SQL}) i, ({BASKETS_SQL}) b, alert_totals a""",
)
def ex1(t):
    return flatten_record(
        dashboard.inventory_summary(
            t.orders,
            t.order_items,
            t.items,
            behavior.temporal_insights(facts(t), t.orders),
            behavior.basket_stats(t.order_items, t.orders),
            alert_totals(t),
        )
    )
