"""Stock report: order behaviour, demand, policy, status, alerts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from larder.operators import behavior, dashboard, forecast, inventory
from larder.plans.report import Report


def restock_list(
    order_items: DataFrame, orders: DataFrame, dim_items: DataFrame, current: DataFrame, **policy
) -> DataFrame:
    """Which items need restocking now: demand, policy, status and alerts in one plan."""
    return inventory.stock_alerts(analysed_stock(order_items, orders, dim_items, current, **policy))


def analysed_stock(
    order_items: DataFrame, orders: DataFrame, dim_items: DataFrame, current: DataFrame, **policy
) -> DataFrame:
    """The inventory analysis of every item that was ever ordered."""
    daily = forecast.daily_demand(forecast.order_lines(order_items, orders))
    planned = inventory.stock_policy(inventory.demand_stats(daily), **policy)
    return inventory.inventory_analysis(inventory.with_item_names(planned, dim_items), current)


def stock_report(
    tables: dict[str, DataFrame], current: DataFrame, with_forecaster: bool = False, **policy
) -> Report:
    """All results by name, with the forecaster if one is fitted. Order facts, daily demand and the analysis are shared and
    kept until released."""
    orders, order_items, items = tables["fct_orders"], tables["fct_order_items"], tables["dim_items"]
    keep = StorageLevel.MEMORY_AND_DISK
    facts = behavior.order_facts(order_items, orders).persist(keep)
    daily = forecast.daily_demand(forecast.order_lines(order_items, orders)).persist(keep)
    planned = inventory.stock_policy(inventory.demand_stats(daily), **policy)
    analysis = inventory.inventory_analysis(inventory.with_item_names(planned, items), current).persist(keep)
    alerts = inventory.stock_alerts(analysis)
    counts = inventory.alert_counts(alerts)
    insights = behavior.temporal_insights(facts, orders)
    baskets = behavior.basket_stats(order_items, orders)
    results = {
        "hourly": behavior.hourly_pattern(facts),
        "weekday": behavior.weekday_pattern(facts),
        "monthly": behavior.monthly_pattern(facts),
        "insights": insights,
        "baskets": baskets,
        "daily_demand": daily,
        "analysis": analysis,
        "alerts": alerts,
        "policy_summary": inventory.optimization_summary(planned),
        "summary": dashboard.inventory_summary(orders, order_items, items, insights, baskets, counts),
    }
    models, kept = {}, [facts, daily, analysis]
    if with_forecaster:
        demand = forecast.demand_features(order_items, orders).persist(keep)
        kept.append(demand)
        fitted = models["forecaster"] = forecast.train_forecaster(forecast.feature_matrix(demand))
        results["metrics"] = forecast.forecaster_metrics(fitted, demand)
        results["importance"] = forecast.feature_importance(fitted.model, fitted.features, demand)
    return Report(results, models, kept)
