"""Column helpers: everything here takes and returns Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Seconds that still fit a nanosecond timestamp; anything beyond is treated as not a date.
MAX_EPOCH = 9223372036


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """A double with NaN and infinities turned to null, so that comparisons and medians see plain numbers."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def number(c: Column | str) -> Column:
    """Text or number to double; null where it does not parse or is NaN."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


def event_time(c: Column | str) -> Column:
    """Epoch seconds to timestamp, null where the value is no usable epoch."""
    seconds = F.coalesce(col(c).try_cast("bigint"), col(c).try_cast("double").try_cast("bigint"))
    return F.when(seconds.between(-MAX_EPOCH, MAX_EPOCH), F.timestamp_seconds(seconds))


def unix_to_text(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(event_time(c), pattern)


def format_currency(c: Column | str, currency: str = "DKK", decimals: int = 2) -> Column:
    v = number(c)
    return F.coalesce(F.concat(F.format_number(v, decimals), F.lit(f" {currency}")), F.lit(f"0.00 {currency}"))


def safe_division(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    top, bottom = col(a).cast("double"), number(b)
    return F.when(bottom.isNull() | (bottom == 0), F.lit(float(default))).otherwise(F.try_divide(top, bottom))


def clean_string(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", ""))


def hour_label(hour: Column | str) -> Column:
    """0..23 to 12am..11pm."""
    h = col(hour).cast("int")
    on_clock = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.concat(on_clock.cast("string"), F.when(h < 12, F.lit("am")).otherwise(F.lit("pm")))


def day_name(ts: Column | str) -> Column:
    return F.date_format(col(ts), "EEEE")


def lookup(key: Column | str, table: dict[str, object]) -> Column:
    """A small constant table as a map literal, so no join is needed."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def flatten_record(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every leaf of nested structs as one top-level column with joined names."""

    def leaves(struct: T.StructType, path: tuple[str, ...]):
        for field in struct.fields:
            here = path + (field.name,)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))


def attach(df: DataFrame, **singles: DataFrame) -> DataFrame:
    """``df`` with one struct column per one-row frame: scalar subqueries, each run once and inlined as a constant."""
    return df.withColumns(
        {name: single.select(F.struct(*single.columns).alias(name)).scalar() for name, single in singles.items()}
    )


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")
    return df


def optional(df: DataFrame, name: str, dtype: str) -> Column:
    """The column when the table has it, a typed null otherwise."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)
