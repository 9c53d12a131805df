"""Order messages with options nobody has listed: known fields typed, unknown ones kept, broken records apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KNOWN = {"order_id": "string", "restaurant_id": "bigint", "total_amount": "double"}


def read_messages(raw: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages, broken) from JSON texts.

    messages: the known fields (null where they are missing or of another type), options (a map of the option object, its values
    as text), rescued (a map of all other fields to their JSON), message (the whole as a variant). broken: the texts that
    are no JSON object, unchanged; null texts among them. Together they are all rows of ``raw``.
    """
    parsed = raw.select(F.col(text).alias("text"), F.try_parse_json(text).alias("message"))
    whole = F.coalesce(F.schema_of_variant("message").startswith("OBJECT"), F.lit(False))
    fields = F.from_json("text", "map<string,string>")
    known = F.array(*[F.lit(k) for k in (*KNOWN, "options")])
    messages = parsed.where(whole).select(
        *[F.try_variant_get("message", f"$.{k}", kind).alias(k) for k, kind in KNOWN.items()],
        F.coalesce(F.try_variant_get("message", "$.options", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("options"),
        F.map_filter(fields, lambda k, _: ~F.array_contains(known, k)).alias("rescued"),
        "message",
    )
    return messages, parsed.where(~whole).select("text")


def option_counts(messages: DataFrame) -> DataFrame:
    """(option, value, orders, revenue) over all options of all messages."""
    each = messages.select("total_amount", F.explode("options").alias("option", "value"))
    return each.groupBy("option", "value").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("revenue"))


def options_of_places(messages: DataFrame) -> DataFrame:
    """(restaurant_id, options): a map from each option chosen at a place to how often; hot places are summed per task first."""
    each = messages.select("restaurant_id", F.explode(F.map_keys("options")).alias("option"))
    counted = each.groupBy("restaurant_id", "option").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("option", "n")))
    return counted.groupBy("restaurant_id").agg(F.map_from_entries(pairs).alias("options"))
