"""Menu engineering."""

from __future__ import annotations

from larder.operators import menu
from larder.registry.base import query, r, rounded
from larder.session import written
from larder.sources.orders import split_orders
from pyspark.sql import functions as F


def performance(t):
    return menu.item_performance(t.most_ordered, t.items)


def live(t):
    _, lines = split_orders(t.order_messages, F.lit("2024-02-01"))
    return menu.live_item_performance(lines, t.live_menu_items)


def classified(t):
    return menu.menu_matrix(written(performance(t), "performance"))


ITEM = "item_id, item_name, order_count"


@query("me1_item_performance", f"SELECT {ITEM}, {r('price', 4)}, {r('revenue', 2)} FROM item_performance")
def me1(t):
    return rounded(performance(t), price=4, revenue=2)


@query(
    "me2_live_item_performance",
    f"SELECT {ITEM}, {r('revenue', 4)}, {r('price', 4)}, category, description, restaurant_id FROM live_performance",
)
def me2(t):
    return rounded(live(t), price=4, revenue=4)


@query(
    "me3_combined_item_performance",
    f"""SELECT item_id, item_name, CAST(sum(order_count) AS BIGINT) AS order_count, {r('avg(price)', 4, 'price')},
               {r('sum(revenue)', 4, 'revenue')}
        FROM (SELECT item_id, item_name, order_count, price, revenue FROM item_performance
              UNION ALL SELECT item_id, item_name, order_count, price, revenue FROM live_performance)
        WHERE item_name IS NOT NULL GROUP BY item_id, item_name""",
)
def me3(t):
    return rounded(menu.combined_item_performance(performance(t), live(t)), price=4, revenue=4)


@query("me4_menu_thresholds", f"SELECT {r('popularity', 4)}, {r('profitability', 4)} FROM thresholds")
def me4(t):
    return rounded(menu.menu_thresholds(performance(t)), popularity=4, profitability=4)


@query("me5_menu_matrix", f"SELECT {ITEM}, {r('price', 4)}, {r('revenue', 2)}, category FROM classified")
def me5(t):
    return rounded(classified(t), price=4, revenue=2)


@query(
    "me6_menu_category_metrics",
    f"""SELECT category, count(item_id) AS item_count, CAST(coalesce(sum(order_count), 0) AS BIGINT) AS total_orders,
               {r('coalesce(sum(revenue), 0)', 2, 'total_revenue')},
               {r('count(item_id) * 100.0::DOUBLE / (SELECT count(*) FROM classified)', 4, 'pct_items')},
               {r('coalesce(sum(revenue), 0) * 100 / (SELECT sum(revenue) FROM classified)', 4, 'pct_revenue')}
        FROM category_actions LEFT JOIN classified USING (category) GROUP BY category""",
)
def me6(t):
    return rounded(menu.menu_category_metrics(classified(t)), total_revenue=2, pct_items=4, pct_revenue=4)


def _top_sql(category: str, order: str, by: str = "revenue", n: int = 10) -> str:
    return f"""SELECT {ITEM}, {r('price', 4)}, {r('revenue', 2)}, category FROM classified WHERE category = '{category}'
               ORDER BY {by} {order}, item_id LIMIT {n}"""


@query("me7_category_top_items", _top_sql("⭐ Star", "DESC"))
def me7(t):
    return rounded(menu.category_top_items(classified(t), "star"), price=4, revenue=2)


@query("me7_category_top_items_dog", _top_sql("🐕 Dog", "ASC", "order_count", 15))
def me7_dog(t):
    return rounded(menu.category_top_items(classified(t), "Dog", 15, "order_count"), price=4, revenue=2)


@query(
    "me8_menu_recommendations",
    "SELECT item_id, item_name, category, action, priority, expected_impact FROM classified JOIN category_actions USING (category)",
)
def me8(t):
    return menu.menu_recommendations(classified(t))


@query(
    "me9_pricing_suggestions",
    f"""SELECT {ITEM}, {r('price', 4)}, suggested_price, {r('revenue', 2)}, {r('potential_revenue', 2)},
               {r('revenue_gain', 2)} FROM suggestions""",
)
def me9(t):
    return rounded(
        menu.pricing_suggestions(classified(t)), price=4, revenue=2, potential_revenue=2, revenue_gain=2
    )


@query(
    "me10_pricing_view",
    f"""SELECT item_id, item_name, {r('price', 4, 'current_price')}, suggested_price,
               {r('suggested_price - price', 4, 'price_change')},
               {r('(suggested_price - price) * 100 / price', 4, 'price_change_pct')},
               'Based on performance analysis' AS rationale, {r('revenue_gain', 2, 'estimated_revenue_impact')}
        FROM suggestions""",
)
def me10(t):
    view = menu.pricing_view(menu.pricing_suggestions(classified(t)))
    return rounded(view, current_price=4, price_change=4, price_change_pct=4, estimated_revenue_impact=2)


@query(
    "me10_pricing_totals",
    f"""SELECT {r('sum(revenue_gain)', 2, 'total_gain')},
               {r('avg((suggested_price - price) * 100 / price)', 4, 'avg_increase_pct')} FROM suggestions""",
)
def me10_totals(t):
    totals = menu.pricing_totals(menu.pricing_view(menu.pricing_suggestions(classified(t))))
    return rounded(totals, total_gain=2, avg_increase_pct=4)


@query(
    "me11_pricing_opportunity",
    f"SELECT {r('sum(revenue_gain)', 2, 'total_revenue_gain')}, count(*) AS items_to_reprice FROM suggestions",
)
def me11(t):
    return rounded(menu.pricing_opportunity(menu.pricing_suggestions(classified(t))), total_revenue_gain=2)


@query(
    "me12_browse_items",
    f"""SELECT {ITEM}, {r('price', 4)}, {r('revenue', 2)}, category FROM classified
        WHERE category = '❓ Puzzle' AND order_count >= 20
          AND item_id IN (SELECT item_id FROM most_ordered WHERE place_id = 7)
        ORDER BY item_id, item_name LIMIT 100""",
)
def me12(t):
    df = menu.browse_items(classified(t), "puzzle", 20, place_items=t.most_ordered, place_id=7)
    return rounded(df, price=4, revenue=2)


@query(
    "me13_recommendations_by_category",
    """SELECT category, action, count(*) AS items_affected, priority, expected_impact
       FROM classified JOIN category_actions USING (category) GROUP BY category, action, priority, expected_impact""",
)
def me13(t):
    return menu.recommendations_by_category(classified(t))


@query(
    "me14_classify_given_demand",
    f"""SELECT item_id, {r('g.price', 4, 'price')}, {r('daily_demand * 730', 2, 'estimated_orders')},
               CASE WHEN daily_demand * 730 >= popularity AND g.price >= profitability THEN '⭐ Star'
                    WHEN daily_demand * 730 >= popularity THEN '🐴 Plowhorse'
                    WHEN g.price >= profitability THEN '❓ Puzzle' ELSE '🐕 Dog' END AS category
        FROM (SELECT i.item_id, i.price, (i.order_count + 0.5) / 730 AS daily_demand FROM item_performance i) g, thresholds""",
)
def me14_given(t):
    items = performance(t)
    given = items.select("item_id", "price", ((F.col("order_count") + 0.5) / 730).alias("daily_demand"))
    df = menu.classify_new_items(given, menu.menu_thresholds(items)).drop("daily_demand")
    return rounded(df, price=4, estimated_orders=2)


@query(
    "me15_menu_items_with_orders",
    f"""SELECT id, price, index, rating, votes, purchases, coalesce(q, 0) AS total_quantity,
               {r('coalesce(rev, 0)', 2, 'total_revenue')}, coalesce(n, 0) AS order_count
        FROM dim_menu_items LEFT JOIN (
          SELECT menu_item_id, sum(quantity) AS q, sum(total_cost) AS rev, count(DISTINCT order_id) AS n
          FROM fct_order_items GROUP BY 1) ON id = menu_item_id""",
)
def me15(t):
    return rounded(menu.menu_items_with_orders(t.menu_items, t.order_items), total_revenue=2)


@query(
    "me16_menu_summary",
    """SELECT (SELECT count(*) FROM dim_items) AS total_items, (SELECT count(DISTINCT place_id) FROM fct_orders) AS total_restaurants,
              (SELECT count(*) FROM fct_orders) AS total_orders, (SELECT count(*) FROM fct_order_items) AS total_order_items,
              (SELECT count(*) FROM dim_campaigns) AS total_campaigns,
              count(*) FILTER (WHERE category = '⭐ Star') AS stars, count(*) FILTER (WHERE category = '🐴 Plowhorse') AS plowhorses,
              count(*) FILTER (WHERE category = '❓ Puzzle') AS puzzles, count(*) FILTER (WHERE category = '🐕 Dog') AS dogs
       FROM classified""",
)
def me16(t):
    return menu.menu_summary(t.items, t.orders, t.order_items, t.campaigns, classified(t))


@query(
    "me17_price_stats",
    f"""SELECT count(price) AS count, {r('avg(price)', 4, 'mean')}, {r('stddev_samp(price)', 4, 'std')},
               {r('min(price)', 4, 'min')}, {r('quantile_cont(price, 0.25)', 4, 'p25')}, {r('quantile_cont(price, 0.5)', 4, 'p50')},
               {r('quantile_cont(price, 0.75)', 4, 'p75')}, {r('max(price)', 4, 'max')} FROM fct_order_items""",
)
def me17(t):
    return rounded(menu.price_stats(t.order_items), mean=4, std=4, min=4, p25=4, p50=4, p75=4, max=4)


@query(
    "me18_price_histogram",
    f"""WITH s AS (SELECT min(price) AS lo, max(price) AS hi FROM fct_order_items),
             c AS (SELECT least(CAST(floor(50.0::DOUBLE * (price - lo) / (hi - lo)) AS INTEGER), 49) AS bin, count(*) AS items
                   FROM fct_order_items, s GROUP BY 1)
        SELECT CAST(b.range AS INTEGER) AS bin, {r('lo + b.range * (hi - lo) / 50', 4, 'bin_start')},
               {r('lo + (b.range + 1) * (hi - lo) / 50', 4, 'bin_end')}, coalesce(items, 0) AS items
        FROM range(50) b CROSS JOIN s LEFT JOIN c ON c.bin = b.range""",
)
def me18(t):
    return rounded(menu.price_histogram(t.order_items), bin_start=4, bin_end=4)


BANDS = """CASE WHEN {p} <= 0 THEN NULL WHEN {p} <= 25 THEN '0-25' WHEN {p} <= 50 THEN '26-50' WHEN {p} <= 75 THEN '51-75'
                WHEN {p} <= 100 THEN '76-100' WHEN {p} <= 150 THEN '101-150' WHEN {p} <= 200 THEN '151-200' ELSE '200+' END"""


@query(
    "me19_price_bands",
    f"""SELECT {BANDS.format(p='discount_amount')} AS band, count(*) AS items FROM fct_order_items
        WHERE discount_amount > 0 GROUP BY 1""",
)
def me19(t):
    return menu.price_bands(t.order_items, "discount_amount")


@query(
    "me20_category_share",
    f"""SELECT category, count(*) AS items, {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM classified)', 4, 'pct')}
        FROM classified GROUP BY category""",
)
def me20(t):
    return rounded(menu.category_share(classified(t)), pct=4)


@query(
    "me20_bubble_sizes",
    f"""SELECT item_id, category, {r('revenue / (SELECT max(revenue) FROM classified) * 500 + 20', 4, 'bubble_size')}
        FROM classified""",
)
def me20_bubbles(t):
    return rounded(menu.bubble_sizes(classified(t)).select("item_id", "category", "bubble_size"), bubble_size=4)


# Mean prices differ in their last bits with the order of rows; rounding them first keeps equal prices equal.
@query(
    "me21_item_scores",
    f"""SELECT item_id, category, {r('percent_rank() OVER (ORDER BY order_count) * 100', 4, 'popularity_score')},
               {r('percent_rank() OVER (ORDER BY round_even(price, 4)) * 100', 4, 'profitability_score')} FROM classified""",
)
def me21(t):
    df = menu.item_scores(rounded(classified(t), price=4)).select("item_id", "category", "popularity_score", "profitability_score")
    return rounded(df, popularity_score=4, profitability_score=4)
