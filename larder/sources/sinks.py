"""Writing results and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from larder.functions.scalars import flatten_record

# ---- fixed values: result names ------------------------------------------------------------------------------
MENU_RESULTS = {
    "classification": "results_menu_engineering",
    "clusters": "results_item_clusters",
    "recommendations": "results_recommendations",
    "pricing": "results_pricing_suggestions",
}
INVENTORY_RESULTS = {
    "hourly": "temporal_patterns_hourly",
    "importance": "feature_importance",
    "analysis": "inventory_analysis",
    "alerts": "inventory_alerts",
    "summary": "executive_summary",
}


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _export(results: dict[str, DataFrame], names: dict[str, str], folder: str) -> dict[str, str]:
    return {
        key: write_csv(flatten_record(results[key]), f"{folder.rstrip('/')}/{name}.csv")
        for key, name in names.items()
        if key in results
    }


def export_menu_results(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Classification, clusters, recommendations and pricing as CSV folders; absent results are skipped."""
    return _export(results, MENU_RESULTS, folder)


def export_inventory_results(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Hourly pattern, importance, analysis, alerts and the flattened summary as CSV folders."""
    return _export(results, INVENTORY_RESULTS, folder)


def export_summary(summary: DataFrame, path: str, file_format: str = "json") -> str:
    """The summary record as JSON (nested) or CSV (flattened)."""
    if file_format == "json":
        summary.write.mode("overwrite").json(path)
    elif file_format == "csv":
        write_csv(flatten_record(summary), path)
    else:
        raise ValueError(f"format must be json or csv, not {file_format}")
    return path


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.write.mode("overwrite").parquet(path)


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
