"""Weekly actions: what to order, promote and prepare."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions import labels as L
from larder.functions.scalars import lookup
from larder.operators.inventory import first_per_status

COLUMNS = ["kind", "item", "message", "priority"]


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def weekly_stock_actions(reports: DataFrame, demand: DataFrame, names: DataFrame) -> DataFrame:
    """One action per latest report that needs one.

    Predicted demand decides first: less than seven days of stock asks for fourteen days' worth. Otherwise stock
    under the reorder point is restocked, and stock over three times of it is excess when it lasts for more than
    sixty days or nothing is predicted.
    """
    stock, reorder, daily = F.col("current_stock"), F.col("reorder_point"), F.col("daily_demand")
    days = F.when(daily > 0, stock / daily).otherwise(F.lit(999.0))
    runs_out = (daily > 0) & (days < 7)
    short = stock < reorder
    plenty = stock > reorder * 3
    kind = (
        F.when(runs_out, L.KIND_DEMAND)
        .when(short, L.KIND_RESTOCK)
        .when(plenty & (daily > 0) & (days > 60), L.KIND_EXCESS_SLOW)
        .when(plenty & (daily == 0), L.KIND_EXCESS)
    )
    message = (
        F.when(
            F.col("kind") == L.KIND_DEMAND, F.format_string(L.MSG_DEMAND, _whole(days), _whole(daily * 14 - stock))
        )
        .when(F.col("kind") == L.KIND_RESTOCK, F.format_string(L.MSG_RESTOCK, _whole(stock), _whole(reorder)))
        .when(
            F.col("kind") == L.KIND_EXCESS_SLOW,
            F.format_string(L.MSG_EXCESS_SLOW, _whole(stock)),
        )
        .otherwise(F.format_string(L.MSG_EXCESS, _whole(stock)))
    )
    low = F.col("kind").isin(L.KIND_DEMAND, L.KIND_RESTOCK)
    return (
        reports.join(demand.select("item_id", "daily_demand"), "item_id", "left")
        .withColumn("daily_demand", F.coalesce("daily_demand", F.lit(0.0)))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .join(names.select("item_id", F.col("item_name").alias("item")), "item_id", "left")
        .withColumns(
            {
                "message": message,
                "priority": F.when(low, "High").otherwise("Medium"),
                "shelf": F.when(low, "low").otherwise("excess"),
            }
        )
        .select("item_id", "date", "shelf", *COLUMNS)
    )


def weekly_capped_actions(actions: DataFrame, low: int = 5, excess: int = 2) -> DataFrame:
    """The first low and excess actions (newest report first, then the higher item), and one summary when more than three are
    low. One report per item is left at this point, so date and item order them fully."""
    order = Window.partitionBy("shelf").orderBy(F.desc("date"), F.desc("item_id"))
    capped = (
        actions.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= max(low, excess))
        .where(F.col("position") <= F.when(F.col("shelf") == "low", low).otherwise(excess))
    )
    summary = (
        actions.agg(F.count_if(F.col("shelf") == "low").alias("n"))
        .where("n > 3")
        .select(
            F.lit(L.KIND_INVENTORY).alias("kind"),
            F.lit("Multiple Items").alias("item"),
            F.format_string(L.MSG_INVENTORY, F.col("n")).alias("message"),
            F.lit("High").alias("priority"),
        )
    )
    return capped.select(*COLUMNS).unionByName(summary)


def weekly_menu_actions(classified: DataFrame, named: bool = True, listed: int = 3) -> DataFrame:
    """One action per category found, with its number of items.

    ``named`` is the form for stocked items: stars and dogs list their first names. The other form speaks of the
    whole menu. Only the first few names of a category are ever gathered.
    """
    counts = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    kinds = {L.STAR: L.KIND_STARS, L.DOG: L.KIND_DOGS, L.PUZZLE: L.KIND_PUZZLES, L.PLOWHORSE: L.KIND_PLOWHORSES}
    priority = F.when(F.col("category").isin(L.DOG, L.PUZZLE), "Medium").otherwise("Low")
    if named:
        by_id = Window.partitionBy("category").orderBy("item_id", "item_name")
        first = (
            classified.where(F.col("category").isin(L.STAR, L.DOG))
            .withColumn("position", F.row_number().over(by_id))
            .where(F.col("position") <= listed)
            .groupBy("category")
            .agg(F.sort_array(F.collect_list(F.struct("position", "item_name"))).alias("first"))
        )
        more = F.when(F.col("n") > listed, F.format_string(" and %d others", F.col("n") - listed)).otherwise("")
        names = F.concat(F.array_join(F.col("first.item_name"), ", "), more)
        message = (
            F.when(F.col("category") == L.STAR, F.format_string(L.MSG_STARS_NAMED, names))
            .when(F.col("category") == L.DOG, F.format_string(L.MSG_DOGS_NAMED, names))
            .when(F.col("category") == L.PUZZLE, L.MSG_PUZZLES_NAMED)
            .otherwise(L.MSG_PLOWHORSES_NAMED)
        )
        rows, what = counts.join(first, "category", "left"), "%d Inventory Items"
    else:
        texts = {L.STAR: L.MSG_STARS, L.DOG: L.MSG_DOGS, L.PUZZLE: L.MSG_PUZZLES, L.PLOWHORSE: L.MSG_PLOWHORSES}
        rows, what, message = counts, "%d Menu Items", lookup("category", texts)
    return rows.select(
        lookup("category", kinds).alias("kind"),
        F.format_string(what, F.col("n")).alias("item"),
        message.alias("message"),
        priority.alias("priority"),
    )


def weekly_actions_from_alerts(
    alerts: DataFrame, counts: DataFrame, critical: int = 3, low: int = 2, excess: int = 2
) -> DataFrame:
    """Without uploads: the first critical, low and excess items of the stock alerts, and an overview."""
    stock, days = _whole("current_stock"), _whole("days_of_stock")
    kinds = {L.CRITICAL: L.KIND_CRITICAL_ML, L.LOW: L.KIND_LOW_ML, L.EXCESS: L.KIND_EXCESS_ML}
    top = first_per_status(alerts, {L.CRITICAL: critical, L.LOW: low, L.EXCESS: excess}).select(
        lookup("status", kinds).alias("kind"),
        F.coalesce("item_name", F.concat(F.lit("Item "), F.col("item_id").cast("string"))).alias("item"),
        F.when(F.col("status") == L.CRITICAL, F.format_string(L.MSG_CRITICAL_ML, stock, days))
        .when(F.col("status") == L.LOW, F.format_string(L.MSG_LOW_ML, stock, _whole("reorder_point")))
        .otherwise(F.format_string(L.MSG_EXCESS_ML, stock, days))
        .alias("message"),
        F.when(F.col("status") == L.CRITICAL, "High").otherwise("Medium").alias("priority"),
    )
    overview = counts.where("critical_items + low_stock_items + excess_items > 0").select(
        F.lit(L.KIND_OVERVIEW).alias("kind"),
        F.lit("All Items").alias("item"),
        F.format_string(L.MSG_OVERVIEW, "critical_items", "low_stock_items", "excess_items").alias("message"),
        F.lit("High").alias("priority"),
    )
    return top.unionByName(overview)


def weekly_recommendations(stock: DataFrame, menu: DataFrame, as_of: dt.date) -> DataFrame:
    """Stock and menu actions, with a weekend reminder on Friday and Saturday, by priority."""
    rows = stock.select(*COLUMNS).unionByName(menu.select(*COLUMNS))
    if as_of.strftime("%A") in ("Friday", "Saturday"):
        reminder = stock.sparkSession.range(1).select(
            F.lit(L.KIND_WEEKEND).alias("kind"),
            F.lit("Staffing & Inventory").alias("item"),
            F.lit(L.MSG_WEEKEND).alias("message"),
            F.lit("Medium").alias("priority"),
        )
        rows = rows.unionByName(reminder)
    return rows.orderBy(F.coalesce(lookup("priority", L.PRIORITY_RANK), F.lit(2)), "kind", "item")
