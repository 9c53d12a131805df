"""Bounded current tables, joined streams, mergeable sketches, local days, open messages, SQL functions and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from larder.functions.sql import register_functions
from larder.operators import local_days, sketches
from larder.registry.base import query, r, rounded
from larder.registry.streams import report_stream
from larder.session import scratch_path, written
from larder.sources import messages, stored
from larder.streaming.current import CurrentTable, stream_current
from larder.streaming.order_join import join_heads_and_lines
from larder.streaming.orders import stream_to_table


@query("st7_current_stock", "SELECT item_id, id, date, current_stock, reorder_point, safety_stock FROM latest_reports")
def st7(t):
    base = scratch_path(t.spark, "current")
    table = CurrentTable(t.spark, f"{base}/table", "item_id", ["date", "id"], most_parts=2)
    stream_current(report_stream(t, f"{base}/in"), table, f"{base}/state").awaitTermination()
    table.merge(t.inventory_reports.limit(0), table.manifest()["batch_id"])  # a batch that was there: nothing changes
    return table.read().withColumn("date", F.col("date").cast("timestamp_ntz"))


def parted_streams(t, base):
    """Purchases as heads and lines in four batches of time order, then one row far ahead in each that closes what is open.

    Every tenth head never comes. The second line of a purchase is sent late, some so late that it belongs to no head.
    """
    bought = t.events.where("event_type = 'purchase'")
    edges = bought.select(F.percentile_approx(F.unix_seconds("ts"), [0.25, 0.5, 0.75])).first()[0]
    quarter = F.size(F.filter(F.lit(edges), lambda e: e < F.unix_seconds("ts")))
    heads = bought.where("event_id % 10 <> 0").select(F.col("event_id").alias("order_id"), F.col("ts").alias("placed"), F.col("value").alias("total"), quarter.alias("q"))
    minutes = F.when(F.col("line_no") == 0, F.col("event_id") % 5).otherwise(F.col("event_id") % 90)
    lines = bought.select("event_id", "ts", quarter.alias("q"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line_no")).select(
        F.col("event_id").alias("order_id"), "line_no", (F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))).alias("sent"), "q"
    )
    end = bought.agg(F.max("ts")).first()[0]
    ahead = F.lit(end) + F.make_dt_interval(F.lit(30))
    last = {"heads": t.spark.range(1).select(F.lit(-1).cast("long").alias("order_id"), ahead.alias("placed"), F.lit(0.0).alias("total"), F.lit(4).alias("q")),
            "lines": t.spark.range(1).select(F.lit(-2).cast("long").alias("order_id"), F.lit(0).alias("line_no"), ahead.alias("sent"), F.lit(4).alias("q"))}
    out = []
    for name, rows in (("heads", heads), ("lines", lines)):
        rows = written(rows.unionByName(last[name]), name)
        for q in range(5):
            rows.where(F.col("q") == q).drop("q").coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        out.append(t.spark.readStream.schema(rows.drop("q").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}"))
    return out


@query(
    "st8_heads_and_lines",
    """WITH bought AS (SELECT event_id, ts, value FROM events WHERE event_type = 'purchase'),
       l AS (SELECT event_id AS order_id, line_no, ts + to_minutes(CAST(CASE WHEN line_no = 0 THEN event_id % 5 ELSE event_id % 90 END AS INTEGER)) AS sent
             FROM bought, (VALUES (0), (1)) v(line_no))
       SELECT l.order_id, l.line_no, h.value AS total, h.event_id IS NOT NULL AS has_head
       FROM l LEFT JOIN bought h ON h.event_id = l.order_id AND h.event_id % 10 <> 0
            AND l.sent >= h.ts - INTERVAL 10 MINUTE AND l.sent <= h.ts + INTERVAL 1 HOUR""",
)
def st8(t):
    base = scratch_path(t.spark, "parted")
    heads, lines = parted_streams(t, base)
    joined = join_heads_and_lines(heads, lines, head_delay="2 hours", line_delay="2 hours")
    stream_to_table(joined, f"{base}/out", f"{base}/state").awaitTermination()
    rows = t.spark.read.schema(joined.schema).parquet(f"{base}/out").where("order_id >= 0")
    return rows.select("order_id", "line_no", "total", F.col("placed").isNotNull().alias("has_head"))


def _sketch_inputs(t):
    orders = t.raw("orders").select(
        F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("order_id")
    )
    lines = t.order_items.select("order_id", F.col("item_id").alias("item")).join(orders.select("order_id", "day"), "order_id")
    return orders, lines


def _daily(t):
    return written(sketches.daily_sketches(*_sketch_inputs(t)), "daily_sketches")


@query(
    "ap1_distinct_from_days",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(DISTINCT o_custkey) AS exact, true AS inside_bound
       FROM orders GROUP BY 1""",
)
def ap1(t):
    year = F.year("day")
    told = sketches.estimates(sketches.merged(_daily(t), year)).select("period", "distinct_customers")
    exact = _sketch_inputs(t)[0].groupBy(year.alias("period")).agg(F.countDistinct("customer").alias("exact"))
    off = F.abs(F.col("distinct_customers") - F.col("exact"))
    return exact.join(told, "period").select("period", "exact", (off <= F.col("exact") * sketches.DISTINCT_ERROR + 1).alias("inside_bound"))


@query(
    "ap2_top_items_from_days",
    """SELECT period, item_id, n FROM (SELECT *, rank() OVER (PARTITION BY period ORDER BY n DESC) AS place FROM (
         SELECT CAST(year(o_orderdate) AS INTEGER) AS period, l_partkey AS item_id, count(*) AS n
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE place <= 10""",
)
def ap2(t):
    """All items at least as frequent as the tenth; the sketches track more items than there are here, so counts are exact."""
    items = t.items.count()
    daily = written(sketches.daily_sketches(*_sketch_inputs(t), most_items=min(max(items * 2, 1024), 1_000_000)), "daily_items")
    whole = sketches.merged(daily, F.year("day"), most_items=min(max(items * 2, 1024), 1_000_000))
    told = whole.select("period", F.explode(F.expr(f"approx_top_k_estimate(items, {min(items, 1000)})")).alias("e")).select("period", "e.item", "e.count")
    place = F.rank().over(Window.partitionBy("period").orderBy(F.desc("count")))
    return told.withColumn("place", place).where("place <= 10").select("period", F.col("item").alias("item_id"), F.col("count").alias("n"))


@query(
    "ap3_quantiles_from_days",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS orders, true AS median_inside, true AS ninth_inside FROM orders GROUP BY 1""",
)
def ap3(t):
    """The share of orders at or below a quantile told by merged sketches lies within the stated rank error."""
    told = sketches.estimates(sketches.merged(_daily(t), F.year("day"))).select("period", "quantiles")
    rows = _sketch_inputs(t)[0].select(F.year("day").alias("period"), "total").join(told, "period")
    share = lambda i: F.avg((F.col("total") <= F.col("quantiles")[i]).cast("int"))
    near = lambda i, q: F.abs(share(i) - q) <= sketches.RANK_ERROR + 1 / F.count(F.lit(1))
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("orders"), near(0, 0.5).alias("median_inside"), near(1, 0.9).alias("ninth_inside"))


ZONES = ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney"]
LOCAL = f"""
    zoned AS (SELECT id AS place_id, CASE id % 5 WHEN 0 THEN '{ZONES[0]}' WHEN 1 THEN '{ZONES[1]}' WHEN 2 THEN '{ZONES[2]}' WHEN 3 THEN '{ZONES[3]}' ELSE 'UTC' END AS zone
              FROM dim_places),
    local_daily AS (SELECT o.place_id, CAST(timezone(z.zone, make_timestamptz(o.created * 1000000)) AS DATE) AS day, sum(l.quantity) AS quantity, count(DISTINCT o.id) AS orders
              FROM fct_orders o JOIN zoned z USING (place_id) JOIN fct_order_items l ON l.order_id = o.id GROUP BY 1, 2)"""


def local_daily(t):
    zone = F.element_at(F.lit(ZONES), (F.col("id") % 5 + 1).cast("int"))
    return local_days.local_demand(t.order_items, t.orders, t.places.withColumn("zone", F.when(F.col("id") % 5 < 4, zone)))


@query("ld1_local_demand", f"WITH {LOCAL} SELECT * FROM local_daily")
def ld1(t):
    return local_daily(t)


@query(
    "ld2_averages_by_days",
    f"""WITH {LOCAL},
        days AS (SELECT place_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM local_daily GROUP BY place_id),
        filled AS (SELECT d.place_id, d.day, coalesce(l.quantity, 0) AS quantity, coalesce(l.orders, 0) AS orders
                   FROM days d LEFT JOIN local_daily l ON d.place_id = l.place_id AND d.day = l.day)
        SELECT place_id, day, quantity, orders,
               {r('avg(quantity) OVER (PARTITION BY place_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)', 4, 'quantity_7d')},
               {r('avg(quantity) OVER (PARTITION BY place_id ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)', 4, 'quantity_14d')}
        FROM filled""",
)
def ld2(t):
    return rounded(local_days.averages_by_days(local_days.every_day(local_daily(t))), quantity_7d=4, quantity_14d=4)


# Messages as texts: options differ from order to order, some have fields nobody knows, some are cut off.
def message_texts(t):
    number, amount = F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("string")
    size = F.when(number % 3 == 0, ',"size":"large"').otherwise("")
    extra = F.when(number % 4 == 0, F.concat(F.lit(',"sauce":'), (number % 6).cast("string"))).otherwise("")
    options = F.concat(F.lit('"options":{"spicy":'), F.when(number % 2 == 0, "true").otherwise("false"), size, extra, F.lit("}"))
    odd = F.when(number % 7 == 0, ',"loyalty":{"card":7}').otherwise("")
    text = F.concat(F.lit('{"order_id":"'), number.cast("string"), F.lit('","restaurant_id":'), (F.col("user_id") % 25).cast("string"), F.lit(',"total_amount":'), amount, F.lit(","), options, odd, F.lit("}"))
    cut = F.when(number % 11 == 0, F.substring(text, 1, 30)).when(number % 13 == 0, F.lit(None)).otherwise(text)
    return t.events.where("event_type = 'purchase'").select(cut.alias("value"))


MESSAGES = """
    told AS (SELECT event_id, user_id % 25 AS restaurant_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS total_amount
             FROM events WHERE event_type = 'purchase' AND event_id % 11 <> 0 AND event_id % 13 <> 0)"""


@query(
    "ms1_messages",
    f"""WITH {MESSAGES} SELECT CAST(event_id AS VARCHAR) AS order_id, restaurant_id, {r('total_amount', 2)},
               CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS spicy, CASE WHEN event_id % 3 = 0 THEN 'large' END AS size,
               CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 6 AS VARCHAR) END AS sauce, CASE WHEN event_id % 7 = 0 THEN '{{"card":7}}' END AS loyalty FROM told""",
)
def ms1(t):
    found, _ = messages.read_messages(message_texts(t))
    option = lambda k: F.col("options").getItem(k).alias(k)
    columns = ["order_id", "restaurant_id", "total_amount", option("spicy"), option("size"), option("sauce"), F.col("rescued").getItem("loyalty").alias("loyalty")]
    return rounded(found.select(*columns), total_amount=2)


@query(
    "ms2_broken_messages",
    """SELECT CASE WHEN event_id % 11 = 0 THEN true ELSE false END AS has_text, count(*) AS n FROM events
       WHERE event_type = 'purchase' AND (event_id % 11 = 0 OR event_id % 13 = 0) GROUP BY 1""",
)
def ms2(t):
    _, broken = messages.read_messages(message_texts(t))
    return broken.groupBy(F.col("text").isNotNull().alias("has_text")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ms3_option_counts",
    f"""WITH {MESSAGES},
        each AS (SELECT 'spicy' AS option, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS value, total_amount FROM told
                 UNION ALL SELECT 'size', 'large', total_amount FROM told WHERE event_id % 3 = 0
                 UNION ALL SELECT 'sauce', CAST(event_id % 6 AS VARCHAR), total_amount FROM told WHERE event_id % 4 = 0)
        SELECT option, value, count(*) AS orders, {r('sum(total_amount)', 2, 'revenue')} FROM each GROUP BY option, value""",
)
def ms3(t):
    return rounded(messages.option_counts(messages.read_messages(message_texts(t))[0]), revenue=2)


@query(
    "ms4_options_of_places",
    f"""WITH {MESSAGES} SELECT restaurant_id, count(*) AS spicy, nullif(count(*) FILTER (event_id % 3 = 0), 0) AS size,
               nullif(count(*) FILTER (event_id % 4 = 0), 0) AS sauce FROM told GROUP BY restaurant_id""",
)
def ms4(t):
    found = messages.options_of_places(messages.read_messages(message_texts(t))[0])
    return found.select("restaurant_id", *[F.col("options").getItem(k).alias(k) for k in ("spicy", "size", "sauce")])


def named_views(t):
    t.order_items.createOrReplaceTempView("fct_order_items")
    t.items.createOrReplaceTempView("dim_items")
    register_functions(t.spark, tables=True)


@query("sq1_item_sales", f"SELECT item_id, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS DOUBLE) AS quantity, {r('sum(total_cost)', 2, 'revenue')} FROM fct_order_items GROUP BY item_id HAVING sum(quantity) >= 500")
def sq1(t):
    named_views(t)
    return rounded(t.spark.sql("SELECT * FROM larder_item_sales(500D)"), revenue=2)


@query(
    "sq2_best_of_type",
    f"""SELECT type, item_id, {r('revenue', 2)}, CAST(place AS INTEGER) AS place FROM (
          SELECT i.type, s.item_id, s.revenue, row_number() OVER (PARTITION BY i.type ORDER BY s.revenue DESC, s.item_id) AS place
          FROM (SELECT item_id, sum(total_cost) AS revenue FROM fct_order_items GROUP BY item_id) s JOIN dim_items i ON s.item_id = i.id) WHERE place <= 3""",
)
def sq2(t):
    named_views(t)
    return rounded(t.spark.sql("SELECT * FROM larder_best_of_type(3)"), revenue=2)


@query(
    "sq3_menu_classes",
    """WITH edge AS (SELECT median(price) AS dear FROM dim_items)
       SELECT CASE WHEN n >= 30 AND price >= dear THEN 'star' WHEN n >= 30 THEN 'plowhorse' WHEN price >= dear THEN 'puzzle' ELSE 'dog' END AS class, count(*) AS items
       FROM (SELECT i.id, i.price, count(l.item_id) AS n FROM dim_items i LEFT JOIN fct_order_items l ON i.id = l.item_id GROUP BY i.id, i.price), edge GROUP BY 1""",
)
def sq3(t):
    named_views(t)
    return t.spark.sql(
        """WITH sold AS (SELECT i.id, i.price, CAST(count(l.item_id) AS DOUBLE) AS n FROM dim_items i LEFT JOIN fct_order_items l ON i.id = l.item_id GROUP BY i.id, i.price)
           SELECT larder_menu_class(n, price, 30D, (SELECT median(price) FROM dim_items)) AS class, count(*) AS items FROM sold GROUP BY 1"""
    )


def _stored(t, file_format="parquet"):
    name, base = f"kept_{uuid.uuid4().hex[:12]}", scratch_path(t.spark, "stored")
    return (*stored.store_orders(t.spark, t.orders, t.order_items, name, base, stored.buckets_for(t.order_items), file_format), name, base)


@query(
    "tb1_stored_order_lines",
    f"""SELECT l.order_id, l.item_id, l.quantity, o.place_id, CAST(o.placed AS DATE) AS order_date, {r('l.price', 4, 'price')}
        FROM fct_order_items l JOIN timed_orders o ON l.order_id = o.id""",
)
def tb1(t):
    orders, lines, *_ = _stored(t)
    return rounded(stored.stored_order_lines(orders, lines).select("order_id", "item_id", "quantity", "place_id", "order_date", "price"), price=4)


@query(
    "tb2_stored_demand_of_a_year",
    """SELECT l.item_id, o.place_id, o.order_date AS date, sum(l.quantity) AS quantity, count(DISTINCT l.order_id) AS orders, strftime(o.order_date, '%Y-%m') AS month
       FROM fct_order_items l JOIN timed_orders o ON l.order_id = o.id WHERE year(o.order_date) = 1996 GROUP BY 1, 2, 3, 6""",
)
def tb2(t):
    orders, lines, name, base = _stored(t, "orc")
    daily = stored.store_daily_demand(stored.stored_order_lines(orders, lines), f"{name}_demand", f"{base}/demand", "orc")
    return daily.where("month >= '1996-01' AND month <= '1996-12'")
