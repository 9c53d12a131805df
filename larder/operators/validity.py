"""What was in force at a point in time: as-of joins and interval joins.

Neither multiplies facts. The as-of join has no join at all: facts and dated values are ordered together, in time buckets, so a key with
a third of the rows is spread over its buckets. The interval join meets a period in the few buckets that it touches; a period
that touches more, or never ends, is joined by its key alone and stands there once. Where only the number of periods in force and the
best of them are wanted, ``standing`` tells both per moment, and facts meet the moments by an as-of join instead of the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86_400


def _seconds(column: Column) -> Column:
    return F.unix_seconds(column.cast("timestamp"))


def as_of(facts: DataFrame, dated: DataFrame, key: str, at: str, since: str, bucket_days: int = 90, tie: str | None = None) -> DataFrame:
    """``facts`` with the other columns of the row of ``dated`` that has the same ``key`` and the latest ``since`` not after ``at``.

    Of rows with the same ``since`` the one with the greatest ``tie`` counts (then the greatest values). Facts before the first
    row, with a null time or a null key have nulls; dated rows with a null key or time never count. Every fact comes back once.
    """
    values = [c for c in dated.columns if c != key]
    picked = F.struct(*[F.col(c) for c in dict.fromkeys([since, *([tie] if tie else []), *values])])
    names = facts.columns
    given = facts.select(
        F.col(key).alias("_key"), _seconds(F.col(at)).alias("_at"), F.lit(2).alias("_kind"), F.struct(*names).alias("_fact")
    )
    rows = dated.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).alias("_key"), _seconds(F.col(since)).alias("_at"), F.lit(1).alias("_kind"), picked.alias("_value")
    )
    both = given.unionByName(rows, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / (bucket_days * DAY)))
    # One row per key and bucket: what the bucket starts with.
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.where("_key IS NOT NULL AND _at IS NOT NULL")
        .groupBy("_key", "_bucket")
        .agg(F.max("_value").alias("_last"))
        .select("_key", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_value"))
        .where("_value IS NOT NULL")
        .withColumns({"_at": F.col("_bucket") * bucket_days * DAY, "_kind": F.lit(0)})
    )
    # A fact without key or time finds nothing and need not meet the others.
    lost = F.col("_key").isNull() | F.col("_at").isNull()
    ordered = Window.partitionBy("_key", "_bucket").orderBy("_at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.where(~lost).unionByName(carried, allowMissingColumns=True).withColumn("_value", F.last("_value", ignorenulls=True).over(ordered))
    done = found.where("_kind = 2").select("_fact", "_value").unionByName(both.where(lost & (F.col("_kind") == 2)).select("_fact", "_value"))
    taken = {c.lower() for c in names}
    return done.select("_fact.*", *[F.col(f"_value.{c}").alias(c) for c in values if c.lower() not in taken])


def in_force(facts: DataFrame, periods: DataFrame, key: str, at: str, start: str, end: str, bucket_days: int = 30, most_buckets: int = 4) -> DataFrame:
    """Facts with every period of the same ``key`` that has started and not ended: start <= at < end. Facts without one are not
    returned.

    A null ``start`` is the beginning of time, a null ``end`` never comes; a period that ends before it starts is never in force.
    Columns of ``periods`` other than the key are added; their names must not be those of ``facts``.
    """
    width = bucket_days * DAY
    given = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumns(
        {"_key": F.col(key), "_at": _seconds(F.col(at)), "_bucket": F.floor(_seconds(F.col(at)) / width)}
    )
    dated = periods.where(F.col(key).isNotNull()).withColumns({"_pkey": F.col(key), "_start": _seconds(F.col(start)), "_end": _seconds(F.col(end))}).drop(key)
    dated = dated.where("_start IS NULL OR _end IS NULL OR _start < _end")
    touched = F.floor((F.col("_end") - 1) / width) - F.floor(F.col("_start") / width) + 1
    short = F.coalesce(touched <= most_buckets, F.lit(False))
    valid = (F.col("_start").isNull() | (F.col("_start") <= F.col("_at"))) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    blocks = F.sequence(F.floor(F.col("_start") / width), F.floor((F.col("_end") - 1) / width))
    brief = dated.where(short).withColumn("_block", F.explode(blocks))
    in_bucket = given.join(brief, (F.col("_key") == F.col("_pkey")) & (F.col("_bucket") == F.col("_block")) & valid).drop("_block")
    lasting = given.join(dated.where(~short), (F.col("_key") == F.col("_pkey")) & valid)
    return in_bucket.unionByName(lasting).drop("_key", "_pkey", "_at", "_start", "_end", "_bucket")


LEVELS = 45  # two to this power is more than all seconds that a timestamp can tell
EARLIEST = -9_223_372_036_854  # the first whole second of a timestamp


def standing(periods: DataFrame, key: str, start: str, end: str, rank: Column) -> DataFrame:
    """Per ``key`` the moments at which a period starts or ends, as ``since``, with ``periods``, the number in force from then on, and
    ``best``, the greatest ``rank`` among them.

    Null ends and keys count as in ``in_force``. No moment meets all periods of its key: a period is cut into aligned spans of 1, 2, 4, ...
    seconds, at most two of each length; their counts and greatest ranks are summed up per span, and a moment looks up the one span
    of each length that it lies in. Rows grow with the periods alone, whatever they overlap.
    """
    origin = 1 << (LEVELS - 1)
    dated = periods.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        (F.coalesce(_seconds(F.col(start)), F.lit(EARLIEST)) + origin).alias("_from"),
        F.coalesce(_seconds(F.col(end)) + origin, F.lit(1 << LEVELS)).alias("_to"),
        rank.alias("_rank"),
    )
    dated = dated.where("_from < _to")
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level")
    first, after = F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_to, _level)")
    spans = (
        dated.select("*", levels)
        .withColumns({"_first": first, "_after": after})
        .where("_first < _after")
        .select("_key", "_level", "_rank", F.explode(F.array(F.when(F.col("_first") % 2 == 1, F.col("_first")), F.when(F.col("_after") % 2 == 1, F.col("_after") - 1))).alias("_span"))
        .where("_span IS NOT NULL")
        .groupBy("_key", "_level", "_span")
        .agg(F.count(F.lit(1)).alias("_periods"), F.max("_rank").alias("_best"))
    )
    moments = dated.select("_key", F.explode(F.array("_from", "_to")).alias("_at")).where(F.col("_at") < 1 << LEVELS).distinct()
    inside = moments.select("*", levels).withColumn("_span", F.expr("shiftright(_at, _level)"))
    return (
        inside.join(spans, ["_key", "_level", "_span"], "left")
        .groupBy("_key", "_at")
        .agg(F.coalesce(F.sum("_periods"), F.lit(0)).alias("periods"), F.max("_best").alias("best"))
        .select(F.col("_key").alias(key), F.timestamp_seconds(F.col("_at") - origin).alias("since"), "periods", "best")
    )


def campaign_at_order(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per order: campaigns in force at its place when it was placed, and the best of them (greatest discount, then least id).

    ``orders``: id, place_id, placed. ``campaigns``: campaign_id, place_id, discount, starts, ends. Orders without a campaign have a
    null campaign_id and 0 campaigns; orders that share an id share their campaigns. Orders never meet single campaigns: they take
    what stands since the last moment at which one of their place's campaigns started or ended.
    """
    heads = orders.select("id", "place_id", "placed")
    rank = F.struct("discount", (-F.col("campaign_id")).alias("least"))
    found = as_of(heads, standing(campaigns, "place_id", "starts", "ends", rank), "place_id", "placed", "since")
    best = found.where("id IS NOT NULL AND periods > 0").groupBy("id").agg(F.sum("periods").alias("campaigns"), F.max("best").alias("best"))
    return heads.join(best, "id", "left").select(
        "id", "place_id", F.coalesce("campaigns", F.lit(0)).alias("campaigns"), (-F.col("best.least")).alias("campaign_id"), F.col("best.discount").alias("discount")
    )


def price_at_order(lines: DataFrame, orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Order lines with the list price in force when their order was placed, and what the line gave away against it.

    ``lines``: order_id, item_id, quantity, price; ``orders``: id, placed; ``prices``: item_id, since, list_price.
    """
    placed = lines.select("order_id", "item_id", "quantity", "price").join(orders.select(F.col("id").alias("order_id"), "placed"), "order_id")
    return as_of(placed, prices.select("item_id", "since", "list_price"), "item_id", "placed", "since").withColumn(
        "given_away", (F.col("list_price") - F.col("price")) * F.col("quantity")
    )
