"""Order heads and order lines that arrive apart, joined while they stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_heads_and_lines(
    heads: DataFrame, lines: DataFrame, early: str = "10 minutes", late: str = "1 hour", head_delay: str = "30 minutes", line_delay: str = "30 minutes"
) -> DataFrame:
    """Lines with the head of their order; a line whose head never comes has nulls in the head's columns.

    ``heads``: order_id, placed, ...; ``lines``: order_id, line_no, sent, ... A line belongs to a head if it was sent at most ``early``
    before and ``late`` after the order was placed. Each stream has its own watermark, so both sides' state is bounded: a head is
    forgotten once no line can belong to it any more, and a line is given up, and returned without a head, once no head can.
    Rows later than their stream's watermark are dropped. Works on batch tables, too, where nothing is late.
    """
    head = heads.withWatermark("placed", head_delay).select(F.col("order_id").alias("head_id"), *[c for c in heads.columns if c != "order_id"])
    line = lines.withWatermark("sent", line_delay)
    near = F.expr(f"sent >= placed - INTERVAL {early} AND sent <= placed + INTERVAL {late}")
    return line.join(head, (F.col("order_id") == F.col("head_id")) & near, "left").drop("head_id")
