"""Table profiles."""

from __future__ import annotations

from larder.operators import profiles
from larder.registry.base import TABLES, named_tables, query, r, rounded


def metrics(source: str, **expressions: str) -> str:
    """One SELECT per metric over a view; metrics without a value are left out."""
    parts = [
        f"SELECT 'totals' AS section, '{name}' AS metric, {r(e, 2, 'value')} FROM {source}" for name, e in expressions.items()
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


def top(source: str, section: str, column: str, n: int | None = None) -> str:
    limit = f"ORDER BY value DESC, metric LIMIT {n}" if n else ""
    return f"""SELECT * FROM (SELECT '{section}' AS section, CAST({column} AS VARCHAR) AS metric, count(*)::DOUBLE AS value
               FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} {limit})"""


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


DAY = "CAST(make_timestamp(created * 1000000) AS DATE)"


@query(
    "pf1_profile_orders",
    union(
        metrics(
            "fct_orders",
            rows="count(*)",
            first_day=f"date_diff('day', DATE '1970-01-01', min({DAY}))",
            last_day=f"date_diff('day', DATE '1970-01-01', max({DAY}))",
            days="floor((max(created) - min(created)) / 86400)",
            revenue_total="sum(total_amount)",
            revenue_avg="avg(total_amount)",
            revenue_std="stddev_samp(total_amount)",
            revenue_median="quantile_cont(total_amount, 0.5)",
            revenue_p25="quantile_cont(total_amount, 0.25)",
            revenue_p75="quantile_cont(total_amount, 0.75)",
            revenue_p95="quantile_cont(total_amount, 0.95)",
        ),
        metrics(
            f"(SELECT count(*) AS n FROM fct_orders GROUP BY date_trunc('month', {DAY}))",
            smallest_month="min(n)",
            largest_month="max(n)",
        ),
        top("fct_orders", "type", "type", 6),
        top("fct_orders", "payment_method", "payment_method", 6),
        top("fct_orders", "source", "source", 6),
        top("fct_orders", "status", "status", 8),
        top("fct_orders", "place", "place_id", 10),
    ),
)
def pf1(t):
    return rounded(profiles.profile_orders(t.orders), value=2)


@query(
    "pf2_profile_order_items",
    metrics(
        "fct_order_items",
        rows="count(*)",
        quantity_total="sum(quantity)",
        quantity_avg="avg(quantity)",
        quantity_max="max(quantity)",
        price_avg="avg(price)",
        price_median="quantile_cont(price, 0.5)",
        price_max="max(price)",
        discounted_lines="count(*) FILTER (WHERE discount_amount > 0)",
        discounted_pct="count(*) FILTER (WHERE discount_amount > 0) * 100.0::DOUBLE / count(*)",
        discount_total="sum(discount_amount)",
        commission_total="sum(commission_amount)",
        cost_avg="avg(cost) FILTER (WHERE cost > 0)",
        cost_lines="count(*) FILTER (WHERE cost > 0)",
    ),
)
def pf2(t):
    return rounded(profiles.profile_order_items(t.order_items), value=2)


def _popular(section: str, column: str, order: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT '{section}' AS section, CAST({column} AS VARCHAR) AS metric,
               CAST(sum(order_count) AS DOUBLE) AS value FROM most_ordered GROUP BY {column} ORDER BY value {order}, metric LIMIT {n})"""


@query(
    "pf3_profile_popularity",
    union(
        _popular("top_items", "item_name", "DESC", 25),
        _popular("bottom_items", "item_name", "ASC", 10),
        _popular("top_places", "place_id", "DESC", 5),
    ),
)
def pf3(t):
    return profiles.profile_popularity(t.most_ordered)


@query(
    "pf4_profile_items",
    union(
        metrics(
            "dim_items",
            rows="count(*)",
            price_min="min(price)",
            price_max="max(price)",
            price_avg="avg(price)",
            price_median="quantile_cont(price, 0.5)",
        ),
        top("dim_items", "status", "status"),
        top("dim_items", "type", "type", 6),
        "SELECT DISTINCT 'vat', CAST(vat AS VARCHAR), vat FROM dim_items",
        "SELECT * FROM (SELECT 'dearest', title, round_even(price, 2) FROM dim_items ORDER BY price DESC, title LIMIT 15)",
        """SELECT * FROM (SELECT 'cheapest_active', title, round_even(price, 2) FROM dim_items
           WHERE status = 'Active' AND price > 0 ORDER BY price, title LIMIT 10)""",
    ),
)
def pf4(t):
    return rounded(profiles.profile_items(t.items), value=2)


@query(
    "pf5_profile_places",
    union(
        metrics(
            "dim_places",
            rows="count(*)",
            active="count(*) FILTER (WHERE active = 1)",
            inactive="count(*) FILTER (WHERE active <> 1)",
        ),
        top("dim_places", "country", "country"),
        top("dim_places", "area", "area", 15),
    ),
)
def pf5(t):
    return profiles.profile_places(t.places)


@query(
    "pf6_profile_campaigns",
    union(
        metrics(
            "dim_campaigns",
            rows="count(*)",
            discount_min="min(discount)",
            discount_max="max(discount)",
            discount_avg="avg(discount)",
        ),
        top("dim_campaigns", "status", "status"),
        top("dim_campaigns", "type", "type", 8),
    ),
)
def pf6(t):
    return rounded(profiles.profile_campaigns(t.campaigns), value=2)


@query(
    "pf7_profile_add_ons",
    union(
        metrics(
            "dim_add_ons",
            rows="count(*)",
            price_avg="avg(price)",
            price_max="max(price)",
            free="count(*) FILTER (WHERE price = 0)",
            free_pct="count(*) FILTER (WHERE price = 0) * 100.0::DOUBLE / count(*)",
        ),
        """SELECT * FROM (SELECT 'active_titles', title, count(*)::DOUBLE FROM dim_add_ons
           WHERE status = 'Active' GROUP BY title ORDER BY title LIMIT 15)""",
    ),
)
def pf7(t):
    return rounded(profiles.profile_add_ons(t.add_ons), value=2)


@query(
    "pf8_profile_users",
    union(
        metrics(
            "dim_users",
            rows="count(*)",
            orders_avg="avg(orders)",
            orders_median="quantile_cont(orders::DOUBLE, 0.5)",
            orders_max="max(orders)",
            ordering_users="count(*) FILTER (WHERE orders > 0)",
            ordering_pct="count(*) FILTER (WHERE orders > 0) * 100.0::DOUBLE / count(*)",
            cltv_avg="avg(cltv) FILTER (WHERE cltv > 0)",
            cltv_median="quantile_cont(cltv, 0.5) FILTER (WHERE cltv > 0)",
            cltv_max="max(cltv) FILTER (WHERE cltv > 0)",
        ),
        top("dim_users", "source", "source", 5),
        top("dim_users", "country", "country", 5),
    ),
)
def pf8(t):
    return rounded(profiles.profile_users(t.users), value=2)


@query(
    "pf9_profile_invoices",
    union(
        metrics("fct_invoice_items", rows="count(*)", amount_total="sum(amount)", amount_avg="avg(amount)"),
        top("fct_invoice_items", "description", "description", 8),
    ),
)
def pf9(t):
    return rounded(profiles.profile_invoices(t.invoices), value=2)


@query(
    "pf10_profile_cash",
    metrics(
        "fct_cash_balances", rows="count(*)", opening_avg="avg(opening_balance)", closing_avg="avg(closing_balance)"
    ),
)
def pf10(t):
    return rounded(profiles.profile_cash(t.cash), value=2)


@query(
    "pf11_revenue_per_place",
    f"""SELECT o.place_id, order_count, {r('total_revenue', 2)}, {r('avg_order', 2)}, coalesce(title, 'place_' || o.place_id) AS name
        FROM (SELECT place_id, count(total_amount) AS order_count, sum(total_amount) AS total_revenue, avg(total_amount) AS avg_order
              FROM fct_orders GROUP BY place_id ORDER BY total_revenue DESC, place_id LIMIT 20) o
        LEFT JOIN dim_places p ON o.place_id = p.id""",
)
def pf11(t):
    return rounded(profiles.revenue_per_place(t.orders, t.places), total_revenue=2, avg_order=2)


@query(
    "pf12_item_revenue",
    f"""SELECT l.item_id, total_qty, {r('total_revenue', 2)}, {r('avg_price', 4)}, order_count, coalesce(title, 'item_' || l.item_id) AS name
        FROM (SELECT item_id, sum(quantity) AS total_qty, sum(price * quantity) AS total_revenue, avg(price) AS avg_price,
                     count(DISTINCT order_id) AS order_count
              FROM fct_order_items GROUP BY item_id ORDER BY total_revenue DESC, item_id LIMIT 30) l
        LEFT JOIN dim_items ON l.item_id = id""",
)
def pf12(t):
    return rounded(profiles.item_revenue(t.order_items, t.items), total_revenue=2, avg_price=4)


@query("pf13_profile_taxonomy", top("dim_taxonomy_terms", "vocabulary", "vocabulary"))
def pf13(t):
    return profiles.profile_taxonomy(t.taxonomy)


@query(
    "pf14_profile_schemas",
    union(*[f"SELECT '{n}' AS table_name, count(*) AS rows, '{c}' AS columns FROM {n}" for n, (_, c) in TABLES.items()]),
)
def pf14(t):
    return profiles.profile_schemas(named_tables(t))
