"""The library's rules as functions of SQL: expressions that the optimizer sees through, no Python worker."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(parameters) -> type: expression
SCALARS = {
    "larder_safe_division(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "CASE WHEN b IS NULL OR b = 0 THEN 0D ELSE a / b END",
    "larder_stock_level(stock DOUBLE, safety DOUBLE, reorder DOUBLE, days DOUBLE) RETURNS STRING": """
        CASE WHEN stock <= 0 OR stock < safety THEN 'critical' WHEN stock < reorder THEN 'low'
             WHEN days > 30 THEN 'excess' WHEN days > 14 THEN 'high' ELSE 'optimal' END""",
    "larder_reorder_point(demand DOUBLE, deviation DOUBLE, lead_days DOUBLE, z DOUBLE) RETURNS DOUBLE": """
        bround(demand * lead_days + bround(z * deviation * sqrt(lead_days)))""",
    "larder_menu_class(orders DOUBLE, price DOUBLE, popular DOUBLE, dear DOUBLE) RETURNS STRING": """
        CASE WHEN orders >= popular AND price >= dear THEN 'star' WHEN orders >= popular THEN 'plowhorse'
             WHEN price >= dear THEN 'puzzle' ELSE 'dog' END""",
}

#: Table functions over the views fct_order_items and dim_items.
TABLES = {
    "larder_item_sales(least_quantity DOUBLE) RETURNS TABLE (item_id BIGINT, orders BIGINT, quantity DOUBLE, revenue DOUBLE)": """
        SELECT item_id, count(DISTINCT order_id), CAST(sum(quantity) AS DOUBLE), sum(total_cost)
        FROM fct_order_items GROUP BY item_id HAVING sum(quantity) >= least_quantity""",
    "larder_best_of_type(n INT) RETURNS TABLE (type STRING, item_id BIGINT, revenue DOUBLE, place INT)": """
        SELECT type, item_id, revenue, place FROM (
          SELECT i.type, s.item_id, s.revenue, row_number() OVER (PARTITION BY i.type ORDER BY s.revenue DESC, s.item_id) AS place
          FROM (SELECT item_id, sum(total_cost) AS revenue FROM fct_order_items GROUP BY item_id) s JOIN dim_items i ON s.item_id = i.id)
        WHERE place <= n""",
}


def register_functions(spark: SparkSession, tables: bool = False) -> list[str]:
    """Make the functions known to ``spark.sql``; with ``tables`` those over the views, which must be there. Their names."""
    given = SCALARS | (TABLES if tables else {})
    for head, body in given.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in given]
