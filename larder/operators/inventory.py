"""Stock policy, status, alerts and requirements."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions import labels as L
from larder.functions.scalars import finite, lookup

UNLIMITED_DAYS = 999.0


def demand_stats(daily: DataFrame) -> DataFrame:
    """Per item over daily demand: mean, spread, total, number of rows, mean price."""
    mean = F.avg("quantity_demanded")
    return (
        daily.where(F.col("item_id").isNotNull())
        .groupBy("item_id")
        .agg(
            mean.alias("avg_daily_demand"),
            F.coalesce(F.stddev_samp("quantity_demanded"), mean * 0.2).alias("demand_std"),
            F.coalesce(F.sum("quantity_demanded"), F.lit(0.0)).alias("total_demand"),
            F.count("quantity_demanded").alias("days_with_demand"),
            F.avg("avg_price").alias("avg_price"),
        )
    )


def stock_policy(
    stats: DataFrame,
    lead_time_days: float = 2.0,
    service_level: float = 0.95,
    holding_cost_pct: float = 0.20,
    order_cost: float = 50.0,
) -> DataFrame:
    """Safety stock, reorder point and economic order quantity per item, in whole units.

    The reorder point builds on the rounded safety stock. An item without holding cost counts as costing 1.
    """
    z = NormalDist().inv_cdf(service_level)
    mean = F.col("avg_daily_demand")
    holding = F.col("avg_price") * holding_cost_pct
    safe_holding = F.when(holding == 0, F.lit(1.0)).otherwise(holding)
    return stats.withColumn(
        "safety_stock", F.bround(F.lit(z) * F.col("demand_std") * F.sqrt(F.lit(float(lead_time_days))), 0)
    ).withColumns(
        {
            "reorder_point": F.bround(mean * lead_time_days + F.col("safety_stock"), 0),
            "eoq": F.bround(F.sqrt(F.try_divide(mean * 365 * 2 * order_cost, safe_holding)), 0),
        }
    )


def with_item_names(policy: DataFrame, dim_items: DataFrame) -> DataFrame:
    names = dim_items.select(F.col("id").alias("item_id"), F.col("title").alias("item_name"))
    return policy.join(names, "item_id", "left")


def days_of_stock(stock: Column, mean: Column) -> Column:
    """Days the stock lasts; null when there is no demand."""
    return F.when(mean > 0, F.try_divide(stock, mean))


def stock_status(stock: Column, mean: Column, safety: Column, reorder: Column) -> Column:
    """Critical, Low, Excess, High or Optimal, tried in that order; no demand means the stock lasts for ever."""
    days = F.coalesce(days_of_stock(stock, mean), F.lit(float("inf")))
    return (
        F.when((stock <= 0) | (stock < safety), L.CRITICAL)
        .when(stock < reorder, L.LOW)
        .when(days > 30, L.EXCESS)
        .when(days > 14, L.HIGH)
        .otherwise(L.OPTIMAL)
    )


def inventory_analysis(policy: DataFrame, current: DataFrame) -> DataFrame:
    """Policy with current stock (0 where unknown), status, days of stock and recommended order."""
    stock, mean = F.col("current_stock"), F.col("avg_daily_demand")
    order = F.greatest(F.col("eoq") - stock + F.col("safety_stock"), F.lit(0.0))
    joined = policy.join(current.select("item_id", "current_stock"), "item_id", "left").withColumn(
        "current_stock", F.coalesce(finite("current_stock"), F.lit(0.0))
    )
    return joined.withColumns(
        {
            "status": stock_status(stock, mean, F.col("safety_stock"), F.col("reorder_point")),
            "days_of_stock": F.coalesce(F.bround(days_of_stock(stock, mean), 1), F.lit(UNLIMITED_DAYS)),
            "recommended_order_qty": F.when(stock < F.col("reorder_point"), F.bround(order, 0)).otherwise(0.0),
        }
    )


def stock_alerts(analysis: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Items with one of the statuses (Critical, Low, Excess), most urgent status first."""
    return analysis.where(F.col("status").isin(statuses or L.ALERT_STATUSES)).orderBy(
        lookup("status", L.STATUS_RANK), "item_id"
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """One row with the number of critical, low and excess items."""
    return alerts.agg(
        F.count_if(F.col("status").contains("Critical")).alias("critical_items"),
        F.count_if(F.col("status").contains("Low")).alias("low_stock_items"),
        F.count_if(F.col("status").contains("Excess")).alias("excess_items"),
    )


def first_per_status(alerts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first items of each status by item id, as many as the cap of the status; position counts from 1."""
    by_status = Window.partitionBy("status").orderBy("item_id")
    return (
        alerts.where(F.col("status").isin(list(caps)))
        .withColumn("position", F.row_number().over(by_status))
        .where(F.col("position") <= max(caps.values()))
        .where(F.col("position") <= lookup("status", caps))
    )


def alert_top_per_status(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The first n items of each alert status with what matters for it."""
    return first_per_status(alerts, {s: n for s in L.ALERT_STATUSES}).select(
        "status", "position", "item_id", "item_name", "current_stock", "recommended_order_qty", "days_of_stock"
    )


def ingredient_requirements(forecast: DataFrame, bill_of_materials: DataFrame) -> DataFrame:
    """Needed quantity and number of items per ingredient, largest need first.

    Forecast rows are summed per item before they meet the bill of materials.
    """
    per_item = forecast.groupBy("item_id").agg(F.sum("predicted_demand").alias("demand"))
    parts = bill_of_materials.select(F.col("parent_sku_id").alias("item_id"), "sku_id", "quantity")
    return (
        per_item.join(parts, "item_id")
        .where(F.col("sku_id").isNotNull())
        .groupBy(F.col("sku_id").alias("ingredient_id"))
        .agg(
            F.coalesce(F.sum(F.col("demand") * F.col("quantity")), F.lit(0.0)).alias("total_qty_needed"),
            F.countDistinct("item_id").alias("used_in_n_items"),
        )
        .orderBy(F.desc("total_qty_needed"), "ingredient_id")
    )


def optimization_summary(policy: DataFrame, lead_time_days: float = 2.0, service_level: float = 0.95) -> DataFrame:
    """One row: items, summed demand and safety stock, mean reorder point, parameters."""
    return policy.agg(
        F.count(F.lit(1)).alias("total_items_analyzed"),
        F.bround(F.sum("avg_daily_demand"), 0).alias("avg_daily_demand_all_items"),
        F.bround(F.sum("safety_stock"), 0).alias("total_safety_stock_needed"),
        F.bround(F.avg("reorder_point"), 1).alias("avg_reorder_point"),
    ).withColumns(
        {
            "lead_time_days": F.lit(float(lead_time_days)),
            "service_level": F.lit(f"{service_level * 100:.0f}%"),
            "z_score": F.lit(round(NormalDist().inv_cdf(service_level), 2)),
        }
    )


def status_distribution(analysis: DataFrame) -> DataFrame:
    """Items per short status name (no symbol, nothing after the dash), with percent."""
    short = F.regexp_replace(F.split_part("status", F.lit(" - "), F.lit(1)), r"^\S*[^\w\s]\S* ", "")
    per = analysis.groupBy(short.alias("status")).agg(F.count(F.lit(1)).alias("items"))
    everything = Window.partitionBy(F.lit(0))  # one row per status
    return per.withColumn("pct", F.col("items") * 100.0 / F.sum("items").over(everything))


def lowest_days_of_stock(analysis: DataFrame, n: int = 20) -> DataFrame:
    """The n critical or low items that run out first."""
    urgent = F.col("status").contains("Critical") | F.col("status").contains("Low")
    return analysis.where(urgent).orderBy("days_of_stock", "item_id").limit(n)


def upload_status(reports: DataFrame, dim_items: DataFrame) -> DataFrame:
    """Status of uploaded stock rows by the upload rule, which knows only the rows' own levels."""
    stock = F.col("current_stock")
    reorder = F.coalesce(finite("reorder_point"), F.lit(0.0))
    safety = F.coalesce(finite("safety_stock"), F.lit(0.0))
    names = dim_items.groupBy(F.col("id").alias("item_id")).agg(F.min("title").alias("_title"))
    return (
        reports.select("item_id", stock, reorder.alias("reorder_point"), safety.alias("safety_stock"))
        .join(names, "item_id", "left")
        .select(
            "item_id",
            F.coalesce("_title", F.concat(F.lit("Item "), F.col("item_id").cast("string"))).alias("item_name"),
            "current_stock",
            "reorder_point",
            "safety_stock",
            F.when(stock <= F.col("safety_stock"), L.CRITICAL)
            .when(stock <= F.col("reorder_point"), L.LOW)
            .when((F.col("reorder_point") > 0) & (stock > F.col("reorder_point") * 3), L.EXCESS)
            .otherwise(L.UPLOAD_OK)
            .alias("status"),
            F.bround(stock / F.greatest(F.col("reorder_point") * 0.1, F.lit(1.0)), 1).alias("days_of_stock"),
            F.greatest(F.col("reorder_point") - stock, F.lit(0.0)).alias("recommended_order_qty"),
        )
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report per item, by date and then by id; combined on the map side, so a hot item is no burden."""
    columns = [c for c in reports.columns if c != "item_id"]
    order = F.struct("date", "id") if "id" in columns else F.struct("date", *[c for c in columns if c != "date"])
    return (
        reports.where(F.col("item_id").isNotNull())
        .groupBy("item_id")
        .agg(F.max_by(F.struct(*columns), order).alias("r"))
        .select("item_id", *[F.col(f"r.{c}").alias(c) for c in columns])
    )


def item_name_lookup(
    ids: DataFrame, dim_items: DataFrame, most_ordered: DataFrame | None = None, live_items: DataFrame | None = None
) -> DataFrame:
    """(item_id, item_name): the first name known to the catalogue, the popularity list or the live menu."""
    sources = [(dim_items, "id", "title"), (most_ordered, "item_id", "item_name"), (live_items, "id", "name")]
    named, found = ids.select("item_id").where("item_id IS NOT NULL").distinct(), []
    for n, (table, key, name) in enumerate(sources):
        if table is None:
            continue
        known = (
            table.where(F.col(name).isNotNull()).groupBy(F.col(key).alias("item_id")).agg(F.min(name).alias(f"_n{n}"))
        )
        named = named.join(known, "item_id", "left")
        found.append(F.col(f"_n{n}"))
    fallback = F.concat(F.lit("Item "), F.col("item_id").cast("string"))
    return named.select("item_id", F.coalesce(*found, fallback).alias("item_name"))


def search_alerts(alerts: DataFrame, text: str = "", sort_by: str = "days_of_stock", descending: bool = False) -> DataFrame:
    """Alerts whose item name contains the text in any case, sorted by a column."""
    order = F.desc(sort_by) if descending else F.asc(sort_by)
    return alerts.where(F.lower("item_name").contains(text.lower())).orderBy(order, "item_id")
