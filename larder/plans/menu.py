"""Menu report: performance, matrix, clusters, recommendations, prices."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from larder.operators import clusters, menu, prediction
from larder.plans.report import Report


def menu_report(
    tables: dict[str, DataFrame],
    live_order_items: DataFrame | None = None,
    live_menu_items: DataFrame | None = None,
    with_clusters: bool = True,
    with_prediction: bool = False,
) -> Report:
    """All results by name, with the models fitted. The per-item performance feeds every one and is kept until released."""
    items = menu.item_performance(tables["most_ordered"], tables["dim_items"])
    if live_order_items is not None and live_menu_items is not None:
        items = menu.combined_item_performance(items, menu.live_item_performance(live_order_items, live_menu_items))
    items = items.persist(StorageLevel.MEMORY_AND_DISK)
    thresholds = menu.menu_thresholds(items)
    classified = menu.menu_matrix(items, thresholds)
    pricing = menu.pricing_suggestions(classified)
    results = {
        "performance": items,
        "thresholds": thresholds,
        "classification": classified,
        "category_metrics": menu.menu_category_metrics(classified),
        "recommendations": menu.menu_recommendations(classified),
        "pricing": pricing,
        "opportunity": menu.pricing_opportunity(pricing),
    }
    models = {}
    if with_clusters:
        fitted = models["clusters"] = clusters.fit_clusters(classified)
        results["clusters"] = clusters.item_clusters(fitted, classified)
        results["cluster_summary"] = clusters.cluster_summary(results["clusters"])
        results["cluster_profiles"] = clusters.cluster_profiles(fitted, classified)
    if with_prediction:
        predictors = models["predictors"] = prediction.train_predictors(tables["dim_menu_items"])
        results["prediction_metrics"] = prediction.predictor_metrics(predictors, classified)
    return Report(results, models, [items])
