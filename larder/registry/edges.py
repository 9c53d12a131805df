"""Sources, data quality, conversation logs and column helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars
from larder.functions.ranks import exact_percentiles, percentile_of
from larder.operators import conversations, quality
from larder.registry.base import TABLES, named_tables, query, r, rounded
from larder.sources.orders import split_orders
from larder.sources.stock import parse_stock, sku_to_inventory


def split(t):
    return split_orders(t.order_messages, F.lit("2024-02-01 00:00:00"))


@query(
    "src4_split_orders",
    "SELECT order_id AS id, restaurant_id, TIMESTAMP '2024-02-01 00:00:00' AS timestamp, total_amount FROM order_messages",
)
def src4_orders(t):
    return split(t)[0].withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "src4_split_order_items",
    f"SELECT order_id, line_no, menu_item_id, quantity, {r('price_at_time', 4)} FROM live_order_items",
)
def src4_lines(t):
    return rounded(split(t)[1], price_at_time=4)


RAW_STOCK = """
    SELECT item_id, quantity, CASE WHEN low_stock_threshold = 30 THEN NULL WHEN low_stock_threshold = 40 THEN 'many'
           ELSE CAST(low_stock_threshold AS VARCHAR) END AS reorder FROM dim_skus"""


def raw_stock(t):
    """SKU rows as an uploaded file would carry them: untidy headers, gaps, and numbers that do not parse."""
    level = F.col("low_stock_threshold")
    return t.skus.select(
        F.col("item_id").alias(" Item_ID "),
        F.col("quantity").cast("string").alias("Current_Stock"),
        F.when(level == 30, None).when(level == 40, "many").otherwise(level.cast("string")).alias("REORDER_POINT"),
    )


@query(
    "src6_ingest_inventory",
    f"""SELECT TIMESTAMP '2024-02-01 00:00:00' AS date, TRY_CAST(item_id AS BIGINT) AS item_id, quantity AS current_stock,
               coalesce(TRY_CAST(reorder AS DOUBLE), 0) AS reorder_point, 0.0::DOUBLE AS safety_stock
        FROM ({RAW_STOCK}) WHERE TRY_CAST(item_id AS BIGINT) IS NOT NULL AND (reorder IS NULL OR TRY_CAST(reorder AS DOUBLE) IS NOT NULL)""",
)
def src6(t):
    valid, _ = parse_stock(raw_stock(t), F.lit("2024-02-01 00:00:00"))
    return valid.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    "src6_rejected_inventory",
    f"""SELECT item_id, CAST(quantity AS VARCHAR) AS current_stock, reorder AS reorder_point FROM ({RAW_STOCK})
        WHERE TRY_CAST(item_id AS BIGINT) IS NULL OR (reorder IS NOT NULL AND TRY_CAST(reorder AS DOUBLE) IS NULL)""",
)
def src6_rejected(t):
    return parse_stock(raw_stock(t), F.lit("2024-02-01 00:00:00"))[1]


@query(
    "src7_sku_to_inventory",
    """SELECT TRY_CAST(item_id AS BIGINT) AS item_id, quantity AS current_stock, low_stock_threshold AS reorder_point,
              low_stock_threshold * 0.5::DOUBLE AS safety_stock FROM dim_skus WHERE TRY_CAST(item_id AS BIGINT) IS NOT NULL""",
)
def src7(t):
    return sku_to_inventory(t.skus)


COLUMNS = [
    *[(c, "bigint") for c in ("order_id", "item_id", "menu_item_id")],
    *[(c, "double") for c in ("quantity", "price", "cost", "total_cost", "discount_amount", "commission_amount")],
]


@query(
    "dq1_quality_report",
    """WITH f AS (SELECT * FROM fct_order_items UNION ALL SELECT * FROM fct_order_items WHERE order_id % 10 = 0),
            d AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
                  FROM (SELECT count(*) AS n FROM f GROUP BY order_id, item_id, menu_item_id, quantity, price, cost, total_cost, discount_amount, commission_amount))
    """
    + " UNION ALL ".join(
        f"""SELECT total_rows, duplicate_rows, '{c}' AS column_name, '{kind}' AS data_type,
                   (SELECT count(*) FROM f WHERE {c} IS NULL) AS null_count FROM d"""
        for c, kind in COLUMNS
    ),
)
def dq1(t):
    """All lines, those of every tenth order twice, so that there are repeats to count."""
    lines = t.order_items.select(*[c for c, _ in COLUMNS])
    return quality.quality_report(lines.union(lines.where("order_id % 10 = 0")))


def _summary_sql(name: str, columns: str) -> str:
    each = columns.split(", ")
    there = " + ".join(f'count("{c}")' for c in each)
    return f"""SELECT '{name}' AS table_name, count(*) AS rows, {len(each)} AS columns, '{columns}' AS column_names,
                      {r(f'CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) * {len(each)} - ({there})) * 100.0::DOUBLE / (count(*) * {len(each)}) END', 4, 'missing_pct')} FROM {name}"""


@query("dq2_data_summary", " UNION ALL ".join(_summary_sql(n, c) for n, (_, c) in TABLES.items()))
def dq2(t):
    return rounded(quality.data_summary(named_tables(t)), missing_pct=4)


# The test tables are clean, so prices and totals are shifted to give the checks something to find.
@query(
    "dq3_integrity_check",
    """SELECT * FROM (
         SELECT 'dim_menu_items' AS table_name, 'items with negative price' AS issue, count(*) AS found
         FROM dim_menu_items WHERE price - 905 < 0
         UNION ALL SELECT 'fct_orders', 'orders with zero total', count(*) FROM fct_orders WHERE floor(total_amount / 1000) = 0
         UNION ALL SELECT 'fct_orders without lines', 'rows whose id has no match', count(*) FROM fct_orders
           WHERE id NOT IN (SELECT order_id FROM fct_order_items)
         UNION ALL SELECT 'fct_order_items', 'rows whose item_id has no match', count(*) FROM fct_order_items
           WHERE item_id NOT IN (SELECT id FROM dim_items)) WHERE found > 0""",
)
def dq3(t):
    return quality.integrity_check(
        t.menu_items.withColumn("price", F.col("price") - 905),
        t.orders.withColumn("total", F.floor(F.col("total_amount") / 1000)),
        [
            ("fct_orders without lines", t.orders, "id", t.order_items, "order_id"),
            ("fct_order_items", t.order_items, "item_id", t.items, "id"),
        ],
    )


@query(
    "lg1_trim_history",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age,
                         first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first_role,
                         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
                         count(*) OVER (PARTITION BY conv_id) AS cnt FROM conversations)
       SELECT conv_id, turn, role, text FROM n
       WHERE age <= CASE WHEN first_role = 'system' AND cnt > 4 THEN 3 ELSE 4 END
          OR (first_role = 'system' AND cnt > 4 AND pos = 1)""",
)
def lg1(t):
    return conversations.trim_history(t.turns, 4)


@query("lg2_visible_history", "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")
def lg2(t):
    return conversations.visible_history(t.turns)


@query(
    "lg3_session_overview",
    "SELECT user_id, count(*) AS message_count, min(ts) AS created_at, max(ts) AS last_activity FROM events GROUP BY user_id",
)
def lg3(t):
    df = conversations.session_overview(t.events)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_activity")})


@query(
    "lg4_expired_sessions",
    """SELECT user_id, max(ts) AS last_activity FROM events GROUP BY user_id
       HAVING max(ts) < TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 4 HOUR""",
)
def lg4(t):
    df = conversations.expired_sessions(t.events, F.lit("2024-01-30 18:00:00").cast("timestamp"))
    return df.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


@query(
    "lg5_token_usage",
    """SELECT count(*) AS total_calls, CAST(sum((turn + 1) * 50) AS BIGINT) AS total_prompt_tokens,
              CAST(sum(length(text) // 4) AS BIGINT) AS total_completion_tokens,
              CAST(sum((turn + 1) * 50) + sum(length(text) // 4) AS BIGINT) AS total_tokens
       FROM conversations WHERE role = 'assistant'""",
)
def lg5(t):
    return conversations.token_usage(t.calls)


@query(
    "lg6_question_intent",
    """WITH q AS (SELECT conv_id, turn, lower(text || CASE conv_id % 4 WHEN 0 THEN ' BEST items?' WHEN 1 THEN ' remove what?'
                                              WHEN 2 THEN ' Grow revenue' ELSE '' END) AS s
                  FROM conversations WHERE role = 'user'),
            i AS (SELECT *, CASE WHEN s LIKE '%best%' OR s LIKE '%top%' OR s LIKE '%performing%' OR s LIKE '%star%' THEN 'best_items'
                                 WHEN s LIKE '%remove%' OR s LIKE '%drop%' OR s LIKE '%eliminate%' OR s LIKE '%dog%' THEN 'items_to_remove'
                                 WHEN s LIKE '%revenue%' OR s LIKE '%increase%' OR s LIKE '%grow%' OR s LIKE '%profit%' THEN 'grow_revenue'
                                 ELSE 'general' END AS intent FROM q)
       SELECT conv_id, turn, intent, CASE intent WHEN 'best_items' THEN 0.85::DOUBLE WHEN 'items_to_remove' THEN 0.82::DOUBLE
                                                 WHEN 'grow_revenue' THEN 0.78::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM i""",
)
def lg6(t):
    return conversations.question_intent(t.questions).select("conv_id", "turn", "intent", "confidence")


# Every seventh order gets an epoch that is no date.
@query(
    "sca1_unix_to_text",
    """SELECT id, CASE WHEN id % 7 <> 0 THEN strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') END AS text
       FROM fct_orders""",
)
def sca1(t):
    created = F.when(F.col("id") % 7 == 0, "99999999999").otherwise(F.col("created").cast("string"))
    return t.orders.select("id", scalars.unix_to_text(created).alias("text"))


@query(
    "sca2_format_currency",
    """SELECT id, CASE WHEN id % 7 = 0 THEN '0.00 DKK' ELSE format('{:,.2f}', total_amount) || ' DKK' END AS text FROM fct_orders""",
)
def sca2(t):
    amount = F.when(F.col("id") % 7 != 0, F.col("total_amount"))
    return t.orders.select("id", scalars.format_currency(amount).alias("text"))


@query("sca3_percentile_of", f"SELECT {r('quantile_cont(total_amount, 0.9)', 4, 'value')} FROM fct_orders")
def sca3(t):
    return rounded(percentile_of(t.orders, "total_amount", 90), value=4)


@query(
    "sca4_safe_division",
    f"""SELECT id, {r('CASE WHEN id % 5 = 0 OR id % 5 = 1 THEN -1 ELSE total_amount / (id % 5) END', 4, 'ratio')} FROM fct_orders""",
)
def sca4(t):
    below = F.when(F.col("id") % 5 != 1, F.col("id") % 5)
    return rounded(t.orders.select("id", scalars.safe_division("total_amount", below, -1.0).alias("ratio")), ratio=4)


@query(
    "sca5_clean_string",
    "SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE lower(title) END AS cleaned FROM dim_items",
)
def sca5(t):
    untidy = F.when(F.col("id") % 7 != 0, F.concat(F.lit(" \t"), F.upper("title"), F.lit("\n ")))
    return t.items.select("id", scalars.clean_string(untidy).alias("cleaned"))


@query(
    "sca6_flatten_record",
    "SELECT id, place_id AS order_place, total_amount AS order_money_total, status AS order_money_status FROM fct_orders",
)
def sca6(t):
    money = F.struct(F.col("total_amount").alias("total"), "status")
    nested = t.orders.select("id", F.struct(F.col("place_id").alias("place"), money.alias("money")).alias("order"))
    return scalars.flatten_record(nested)


@query(
    "sca7_hour_label",
    """SELECT id, CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END || CASE WHEN hour < 12 THEN 'am' ELSE 'pm' END AS label
       FROM timed_orders""",
)
def sca7(t):
    hour = F.hour(scalars.event_time("created"))
    return t.orders.select("id", scalars.hour_label(hour).alias("label"))


@query(
    "sca3_percentiles_of_narrowed_ranges",
    "SELECT " + ", ".join(r(f"quantile_cont({c}, {p})", 6, f"{c}_{int(p * 100)}")
                          for c in ("price", "quantity") for p in (0.0, 0.25, 0.5, 0.95, 1.0)) + " FROM fct_order_items",
)
def sca3_narrowed(t):
    """With a coarse sketch the narrowing that large columns need runs on these tables, too."""
    targets = {f"{c}_{int(p * 100)}": (c, p) for c in ("price", "quantity") for p in (0.0, 0.25, 0.5, 0.95, 1.0)}
    return rounded(exact_percentiles(t.order_items, targets, accuracy=25), **{name: 6 for name in targets})
