"""Data quality: reports per table and checks across tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.scalars import number


def _is_missing(df: DataFrame, name: str) -> Column:
    missing = F.col(name).isNull()
    if dict(df.dtypes)[name] in ("double", "float"):
        missing = missing | F.isnan(name)
    return missing


def null_counts(df: DataFrame) -> DataFrame:
    """Null count and type per column, in one pass."""
    counts = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns])
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(c).alias("null_count"))
        for c, t in df.dtypes
    ]
    return counts.select(F.inline(F.array(*cells)))


def quality_report(df: DataFrame) -> DataFrame:
    """Per column its type and null count, with the table's row count and number of repeated rows.

    Repeats are all copies of a fully equal row but the first. Rows are grouped by the columns themselves, so the number is
    exact; copies within a task are combined before the shuffle.
    """
    copies = (
        df.groupBy(*[F.col(f"`{c}`") for c in df.columns])
        .agg(F.count(F.lit(1)).alias("count"))
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )
    total = copies.select("total_rows").scalar()
    repeated = copies.select("duplicate_rows").scalar()
    return null_counts(df).select(
        total.alias("total_rows"), repeated.alias("duplicate_rows"), "column_name", "data_type", "null_count"
    )


def data_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, column names and percent of null cells."""

    def summary(name: str, df: DataFrame) -> DataFrame:
        nulls = reduce(lambda a, b: a + b, [_is_missing(df, c).cast("int") for c in df.columns])
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls.cast("bigint")).alias("nulls")).select(
            F.lit(name).alias("table_name"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(", ".join(df.columns)).alias("column_names"),
            F.coalesce(
                F.try_divide(F.col("nulls") * 100.0, F.col("rows") * F.lit(len(df.columns))), F.lit(0.0)
            ).alias("missing_pct"),
        )

    return reduce(DataFrame.unionByName, [summary(n, d) for n, d in tables.items()])


def integrity_check(
    menu_items: DataFrame,
    orders: DataFrame,
    references: list[tuple[str, DataFrame, str, DataFrame, str]] = (),
    total: str = "total",
) -> DataFrame:
    """Issues with their counts; a check without findings gives no row.

    Checked are negative prices, zero order totals, and for each reference
    ``(label, child, child key, parent, parent key)`` the child rows whose key has no parent.
    """
    checks = []
    if "price" in menu_items.columns:
        checks.append(("dim_menu_items", "items with negative price", menu_items.where(number("price") < 0)))
    if total in orders.columns:
        checks.append(("fct_orders", "orders with zero total", orders.where(number(total) == 0)))
    for label, child, key, parent, parent_key in references:
        keys = parent.select(F.col(parent_key).alias(key)).distinct()
        checks.append((label, f"rows whose {key} has no match", child.where(F.col(key).isNotNull()).join(keys, key, "left_anti")))
    rows = [
        found.agg(F.count(F.lit(1)).alias("found")).select(
            F.lit(table).alias("table_name"), F.lit(issue).alias("issue"), "found"
        )
        for table, issue, found in checks
    ]
    return reduce(DataFrame.unionByName, rows).where("found > 0")
