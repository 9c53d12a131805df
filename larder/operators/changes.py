"""Differences of two snapshots of a table, and putting them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, columns ...): rows that only ``new`` has (added) or only ``old`` has (removed), as often as they are more there.

    Both need the same columns. Nulls equal nulls; a row that stands three times in one and once in the other comes twice.
    """
    columns = old.columns
    added = new.select(columns).exceptAll(old).select(F.lit("added").alias("change"), *columns)
    return added.unionByName(old.exceptAll(new.select(columns)).select(F.lit("removed").alias("change"), *columns))


def unchanged_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that both have, as often as both have them."""
    return old.intersectAll(new.select(old.columns))


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The newer snapshot from the older one and its ``row_changes``."""
    columns = old.columns
    kept = old.exceptAll(changes.where("change = 'removed'").select(columns))
    return kept.unionByName(changes.where("change = 'added'").select(columns))


def _both(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def field_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key that differs: keys, copy, change (added, removed, changed), fields, before, after.

    fields lists the columns with other values, before and after map them to their values as text (for added and removed rows every
    column with a value). Null keys are keys. Rows that repeat a key are paired in the order of their values; copy counts them.
    """
    columns = [c for c in old.columns if c not in keys]
    each = Window.partitionBy(*keys).orderBy(*columns)
    before, after = (df.select(*keys, *columns).withColumn("copy", F.row_number().over(each)) for df in (old, new))
    after = after.select(*[F.col(c).alias(f"new_{c}") for c in after.columns])
    same = _both([F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in [*keys, "copy"]])
    joined = before.join(after, same, "full")
    gone, came = F.col("new_copy").isNull(), F.col("copy").isNull()
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in columns]))
    as_text = lambda prefix: F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"{prefix}{c}").cast("string").alias("v")) for c in columns]),
            lambda e: F.array_contains(F.col("fields"), e["k"]) & e["v"].isNotNull(),
        )
    )
    change = F.when(came, "added").when(gone, "removed").otherwise("changed")
    found = joined.withColumns({"change": change, "fields": differs})
    return found.where("change <> 'changed' OR size(fields) > 0").select(
        *[F.when(came, F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        F.coalesce("copy", "new_copy").alias("copy"),
        "change", "fields", as_text("").alias("before"), as_text("new_").alias("after"),
    )
