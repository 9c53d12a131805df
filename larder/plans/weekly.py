"""From stock reports to the week's list of actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from larder.operators import inventory, menu, weekly


def weekly_report(
    reports: DataFrame, demand: DataFrame, names: DataFrame, prices: DataFrame, thresholds: DataFrame, as_of: dt.date
) -> DataFrame:
    """Actions for uploaded stock: newest report per item, predicted demand, category by stored thresholds."""
    latest = inventory.latest_report(reports)
    actions = weekly.weekly_capped_actions(weekly.weekly_stock_actions(latest, demand, names))
    stocked = (
        latest.select("item_id")
        .join(prices.select("item_id", "price"), "item_id", "left")
        .join(demand.select("item_id", "daily_demand"), "item_id", "left")
        .join(names.select("item_id", "item_name"), "item_id", "left")
    )
    classified = menu.classify_new_items(stocked.fillna(0.0, subset=["price"]), thresholds)
    return weekly.weekly_recommendations(actions, weekly.weekly_menu_actions(classified), as_of)


def weekly_report_without_uploads(alerts: DataFrame, classified: DataFrame, as_of: dt.date) -> DataFrame:
    """Actions from the stock alerts and the menu matrix alone."""
    actions = weekly.weekly_actions_from_alerts(alerts, inventory.alert_counts(alerts))
    return weekly.weekly_recommendations(actions, weekly.weekly_menu_actions(classified, named=False), as_of)
