"""Table profiles in long form: section, metric, value.

Each profile is a union of one-row aggregates and top counts. All value counts of a table share one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions.ranks import exact_percentiles
from larder.functions.scalars import event_time, number

TOTALS = "totals"


def metric_rows(one: DataFrame, section: str = TOTALS) -> DataFrame:
    """The columns of a one-row frame as rows; metrics without a value are left out."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.lit(section).alias("section"), F.inline(F.array(*cells))).where("value IS NOT NULL")


def value_counts(df: DataFrame, sections: dict[str, tuple[Column | str, int | None]]) -> DataFrame:
    """The commonest values of several columns: ``section -> (column, how many, None for all)``.

    The columns are stacked so that one scan and one shuffle serve them all. The cut to the top rows is done per
    partition before rows of a section meet.
    """
    cells = [
        F.struct(F.lit(s).alias("section"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("metric"))
        for s, (c, _) in sections.items()
    ]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where("metric IS NOT NULL")
        .groupBy("section", "metric")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    return _top(counts, {s: k for s, (_, k) in sections.items()})


def _top(rows: DataFrame, keep: dict[str, int | None], ascending: bool = False) -> DataFrame:
    """The first rows of each section by value and then name."""
    limits = {s: k for s, k in keep.items() if k is not None}
    whole = [s for s in keep if s not in limits]
    parts = []
    if whole:
        parts.append(rows.where(F.col("section").isin(whole)))
    if limits:
        value = F.asc("value") if ascending else F.desc("value")
        position = F.row_number().over(Window.partitionBy("section").orderBy(value, "metric"))
        limit = F.coalesce(*[F.when(F.col("section") == s, F.lit(k)) for s, k in limits.items()])
        parts.append(
            rows.where(F.col("section").isin(list(limits)))
            .withColumn("position", position)
            .where(F.col("position") <= max(limits.values()))
            .where(F.col("position") <= limit)
            .drop("position")
        )
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _present(df: DataFrame, sections: dict[str, tuple[str, int | None]]) -> dict[str, tuple[str, int | None]]:
    return {s: (c, k) for s, (c, k) in sections.items() if c in df.columns}


def _counts_of(df: DataFrame, sections: dict[str, tuple[str, int | None]]) -> list[DataFrame]:
    """Value counts of the columns the table has."""
    present = _present(df, sections)
    return [value_counts(df, present)] if present else []


def profile_orders(orders: DataFrame, listed: int | None = 6, statuses: int | None = 8, places: int | None = 10) -> DataFrame:
    """Date range, months, order values, and the commonest types, payments, sources, statuses and places.

    ``listed`` (of types, payments and sources), ``statuses`` and ``places`` limit the lists; None lists all values.
    """
    amount, at = number("total_amount"), event_time("created")
    span = orders.agg(
        F.count(F.lit(1)).alias("rows"),
        F.unix_date(F.to_date(F.min(at))).alias("first_day"),
        F.unix_date(F.to_date(F.max(at))).alias("last_day"),
        F.floor((F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))) / 86400).alias("days"),
        F.sum(amount).alias("revenue_total"),
        F.avg(amount).alias("revenue_avg"),
        F.stddev_samp(amount).alias("revenue_std"),
    )
    quantiles = exact_percentiles(
        orders,
        {f"revenue_{n}": (amount, p) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))},
    )
    months = (
        orders.select(F.date_trunc("month", at).alias("month"))
        .where("month IS NOT NULL")
        .groupBy("month")
        .count()
        .agg(F.min("count").alias("smallest_month"), F.max("count").alias("largest_month"))
    )
    sections = {
        "type": ("type", listed),
        "payment_method": ("payment_method", listed),
        "source": ("source", listed),
        "status": ("status", statuses),
        "place": ("place_id", places),
    }
    return _all([metric_rows(span), metric_rows(quantiles), metric_rows(months), *_counts_of(orders, sections)])


def profile_order_items(order_items: DataFrame) -> DataFrame:
    """Quantities, prices, discounts, commission and cost of order lines."""
    q, price = number("quantity"), number("price")
    discount, fee, cost = number("discount_amount"), number("commission_amount"), number("cost")
    totals = order_items.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(q).alias("quantity_total"),
        F.avg(q).alias("quantity_avg"),
        F.max(q).alias("quantity_max"),
        F.avg(price).alias("price_avg"),
        F.max(price).alias("price_max"),
        F.count_if(discount > 0).alias("discounted_lines"),
        F.try_divide(F.count_if(discount > 0) * 100.0, F.count(F.lit(1))).alias("discounted_pct"),
        F.sum(discount).alias("discount_total"),
        F.sum(fee).alias("commission_total"),
        F.avg(F.when(cost > 0, cost)).alias("cost_avg"),
        F.count_if(cost > 0).alias("cost_lines"),
    )
    return _all([metric_rows(totals), metric_rows(exact_percentiles(order_items, {"price_median": (price, 0.5)}))])


def profile_popularity(most_ordered: DataFrame, top: int | None = 25, bottom: int | None = 10, places: int | None = 5) -> DataFrame:
    """Orders per item name over all places, the most and the least ordered; the places with most item orders.

    The limits are the caller's; None lists all.
    """

    def per(column: str, section: str) -> DataFrame:
        return (
            most_ordered.where(F.col(column).isNotNull())
            .groupBy(F.col(column).cast("string").alias("metric"))
            .agg(F.coalesce(F.sum("order_count"), F.lit(0)).cast("double").alias("value"))
            .select(F.lit(section).alias("section"), "metric", "value")
        )

    return _all(
        [
            _top(per("item_name", "top_items"), {"top_items": top}),
            _top(per("item_name", "bottom_items"), {"bottom_items": bottom}, ascending=True),
            _top(per("place_id", "top_places"), {"top_places": places}),
        ]
    )


def profile_items(
    items: DataFrame, types: int | None = 6, dearest: int | None = 15, cheapest: int | None = 10, vat_rates: int | None = None
) -> DataFrame:
    """Prices, statuses, types and all VAT rates; the dearest and the cheapest active items. None lists all."""
    price = number("price")
    totals = items.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.avg(price).alias("price_avg"),
    )
    vat = items.select(number("vat").alias("value")).where("value IS NOT NULL").distinct()
    if vat_rates is not None:
        vat = vat.orderBy("value").limit(vat_rates)
    active = F.col("status") == "Active" if "status" in items.columns else F.lit(True)

    def listed(rows: DataFrame, section: str, order: Column, n: int | None) -> DataFrame:
        return (
            (rows if n is None else rows.orderBy(order, "title", "id").limit(n))
            .select(F.lit(section).alias("section"), F.col("title").alias("metric"), price.alias("value"))
        )

    return _all(
        [
            metric_rows(totals),
            metric_rows(exact_percentiles(items, {"price_median": (price, 0.5)})),
            *_counts_of(items, {"status": ("status", None), "type": ("type", types)}),
            vat.select(F.lit("vat").alias("section"), F.col("value").cast("string").alias("metric"), "value"),
            listed(items.where(price.isNotNull()), "dearest", F.desc("price"), dearest),
            listed(items.where(active & (price > 0)), "cheapest_active", F.asc("price"), cheapest),
        ]
    )


def profile_places(places: DataFrame, areas: int | None = 15) -> DataFrame:
    """Active and inactive places, countries, currencies, areas, cuisine tags and ratings."""
    active = F.col("active").cast("string").isin("1", "1.0", "true")
    parts = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(active).alias("active"),
        (F.count(F.lit(1)) - F.count_if(active)).alias("inactive"),
    ]
    if "cuisine_ids" in places.columns:
        parts.append(F.count("cuisine_ids").alias("with_cuisine"))
    if "rating" in places.columns:
        parts += [F.avg(number("rating")).alias("rating_avg"), F.max(number("rating")).alias("rating_max")]
    sections = {"country": ("country", None), "currency": ("currency", None), "area": ("area", areas)}
    return _all([metric_rows(places.agg(*parts)), *_counts_of(places, sections)])


def profile_campaigns(campaigns: DataFrame, types: int | None = 8) -> DataFrame:
    """Campaigns by status and type, and the range of discounts."""
    discount = number("discount")
    totals = campaigns.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(discount).alias("discount_min"),
        F.max(discount).alias("discount_max"),
        F.avg(discount).alias("discount_avg"),
    )
    return _all([metric_rows(totals), *_counts_of(campaigns, {"status": ("status", None), "type": ("type", types)})])


def profile_add_ons(add_ons: DataFrame, listed: int | None = 15) -> DataFrame:
    """Prices, free add-ons, and the first active titles in order of their name (None lists all)."""
    price = number("price")
    totals = add_ons.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(price).alias("price_avg"),
        F.max(price).alias("price_max"),
        F.count_if(price == 0).alias("free"),
        F.try_divide(F.count_if(price == 0) * 100.0, F.count(F.lit(1))).alias("free_pct"),
    )
    titles = (
        add_ons.where((F.col("status") == "Active") & F.col("title").isNotNull())
        .groupBy(F.col("title").alias("metric"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit("active_titles").alias("section"), "metric", "value")
    )
    if listed is not None:
        titles = titles.orderBy("metric").limit(listed)
    return metric_rows(totals).unionByName(titles)


def profile_users(users: DataFrame, listed: int | None = 5) -> DataFrame:
    """Orders per user, lifetime value of those who have any, and the commonest sources and countries."""
    orders, cltv = number("orders"), number("cltv")
    spent = F.when(cltv > 0, cltv)
    totals = users.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(orders).alias("orders_avg"),
        F.max(orders).alias("orders_max"),
        F.count_if(orders > 0).alias("ordering_users"),
        F.try_divide(F.count_if(orders > 0) * 100.0, F.count(F.lit(1))).alias("ordering_pct"),
        F.avg(spent).alias("cltv_avg"),
        F.max(spent).alias("cltv_max"),
    )
    medians = exact_percentiles(users, {"orders_median": (orders, 0.5), "cltv_median": (spent, 0.5)})
    return _all(
        [
            metric_rows(totals),
            metric_rows(medians),
            *_counts_of(users, {"source": ("source", listed), "country": ("country", listed)}),
        ]
    )


def profile_invoices(invoices: DataFrame, descriptions: int | None = 8) -> DataFrame:
    """Total and mean amount, and the commonest descriptions."""
    amount = number("amount")
    totals = invoices.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("amount_total"), F.avg(amount).alias("amount_avg")
    )
    return _all([metric_rows(totals), *_counts_of(invoices, {"description": ("description", descriptions)})])


def profile_cash(cash: DataFrame) -> DataFrame:
    """Mean opening and closing balance."""
    return metric_rows(
        cash.agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(number("opening_balance")).alias("opening_avg"),
            F.avg(number("closing_balance")).alias("closing_avg"),
        )
    )


def revenue_per_place(orders: DataFrame, places: DataFrame, n: int = 20) -> DataFrame:
    """Orders with a value, revenue and mean order of the n places with most revenue, with their names."""
    amount = number("total_amount")
    top = (
        orders.where("place_id IS NOT NULL")
        .groupBy("place_id")
        .agg(
            F.count(amount).alias("order_count"),
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_revenue"),
            F.avg(amount).alias("avg_order"),
        )
        .orderBy(F.desc("total_revenue"), "place_id")
        .limit(n)
    )
    return _named(top, "place_id", places, "place_").orderBy(F.desc("total_revenue"), "place_id")


def item_revenue(order_items: DataFrame, items: DataFrame, n: int = 30) -> DataFrame:
    """Quantity, revenue, mean price and orders of the n items with most revenue, with their names."""
    price, quantity = number("price"), number("quantity")
    top = (
        order_items.where("item_id IS NOT NULL")
        .groupBy("item_id")
        .agg(
            F.coalesce(F.sum(quantity), F.lit(0.0)).alias("total_qty"),
            F.coalesce(F.sum(price * quantity), F.lit(0.0)).alias("total_revenue"),
            F.avg(price).alias("avg_price"),
            F.countDistinct("order_id").alias("order_count"),
        )
        .orderBy(F.desc("total_revenue"), "item_id")
        .limit(n)
    )
    return _named(top, "item_id", items, "item_").orderBy(F.desc("total_revenue"), "item_id")


def _named(top: DataFrame, key: str, lookup: DataFrame, prefix: str) -> DataFrame:
    """The rows of a short top list with the name of their key."""
    names = lookup.select(F.col("id").cast("bigint").alias("_id"), F.col("title").alias("_title"))
    own = F.col(key).cast("bigint")
    return top.join(names, own == F.col("_id"), "left").select(
        *top.columns, F.coalesce("_title", F.concat(F.lit(prefix), F.col(key).cast("string"))).alias("name")
    )


def profile_taxonomy(terms: DataFrame) -> DataFrame:
    """Terms per vocabulary."""
    return value_counts(terms, {"vocabulary": ("vocabulary", None)})


def profile_schemas(tables: dict[str, DataFrame], n: int | None = None) -> DataFrame:
    """Rows and the columns of each table (the first ``n``, if given)."""
    return _all(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table_name"), "rows", F.lit(", ".join(df.columns[:n])).alias("columns")
            )
            for name, df in tables.items()
        ]
    )
