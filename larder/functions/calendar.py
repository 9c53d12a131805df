"""Calendar columns derived from an order time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.scalars import day_name, event_time


def calendar_fields(day: Column) -> dict[str, Column]:
    """Weekday (Monday 0), month, ISO week and weekend flag of a date."""
    weekday = F.weekday(day)
    return {
        "day_of_week": weekday,
        "month": F.month(day),
        "week_of_year": F.weekofyear(day),
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
    }


def order_calendar(orders: DataFrame, created: str = "created") -> DataFrame:
    """Orders with order_datetime, order_date, hour, weekday, day name, month, ISO week and weekend flag.

    An epoch that is no date leaves all of them null; the order itself stays.
    """
    timed = orders.withColumn("order_datetime", event_time(created))
    day = F.to_date("order_datetime")
    return timed.withColumns(
        {
            "order_date": day,
            "hour": F.hour("order_datetime"),
            "day_name": day_name("order_datetime"),
            **{
                k: F.when(F.col("order_datetime").isNotNull(), v) for k, v in calendar_fields(day).items()
            },
        }
    )
