"""Exact percentiles and ranks that never put a whole column into one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one task. For a whole fact table that does
not hold, so the rank is first narrowed with a mergeable sketch and only the values next to it are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions.scalars import finite

SKETCH_GROUPS = 64  # sketches are merged in this many tasks, not in one
SLICES = 128  # slices of a narrowed range, each ordered by a task of its own


def exact_percentiles(
    df: DataFrame, targets: dict[str, tuple[Column | str, float]], accuracy: int = 1_000
) -> DataFrame:
    """One row with the linearly interpolated percentile of each target ``name -> (column, fraction)``.

    Runs one job when called. It counts the values and brackets each wanted rank: the sketch error is at most
    1/accuracy of the rows, and the bracket is two errors wide on either side. Taking the lowest and highest
    bracket over groups of partitions keeps it valid however rows are spread. Up to 100 * accuracy values Spark's
    own ``percentile`` is exact in one task and takes over; beyond that only values inside a bracket are ordered.
    Nulls, NaN and infinities are ignored; a column without values gives null.
    """
    columns: dict[object, str] = {}  # one sketch per column, however many percentiles are wanted of it
    wanted: dict[str, list[tuple[str, float]]] = {}
    picked = []
    for name, (c, p) in targets.items():
        key = c if isinstance(c, str) else id(c)
        if key not in columns:
            columns[key] = f"v{len(columns)}"
            wanted[columns[key]] = []
            picked.append(finite(c).alias(columns[key]))
        wanted[columns[key]].append((name, p))
    values = df.select(*picked)
    counts, brackets = _brackets(values, wanted, accuracy)
    if all(n <= 100 * accuracy for n in counts.values()):
        parts = [F.percentile(v, F.lit(p)).alias(name) for v, targets_ in wanted.items() for name, p in targets_]
        return values.agg(*parts).select(*targets)
    return _pick_ranks(values, wanted, counts, brackets).select(*targets)


def _brackets(values: DataFrame, wanted: dict[str, list[tuple[str, float]]], accuracy: int):
    """Number of values per column, and the merged value ranges that hold the wanted ranks."""
    margin = 2.0 / accuracy
    sketches, merged = [], []
    for v, targets in wanted.items():
        ends = [e for _, p in targets for e in (max(0.0, p - margin), min(1.0, p + margin))]
        sketches += [F.count(v).alias(f"n_{v}"), F.percentile_approx(v, ends, accuracy).alias(f"q_{v}")]
        merged.append(F.sum(f"n_{v}").alias(f"n_{v}"))
        for k in range(len(targets)):
            merged.append(F.min(F.col(f"q_{v}")[2 * k]).alias(f"lo_{v}_{k}"))
            merged.append(F.max(F.col(f"q_{v}")[2 * k + 1]).alias(f"hi_{v}_{k}"))
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))
    row = values.groupBy(group.alias("g")).agg(*sketches).agg(*merged).first()
    counts = {v: row[f"n_{v}"] or 0 for v in wanted}
    ranges = {}
    for v, targets in wanted.items():
        ends = sorted((row[f"lo_{v}_{k}"], row[f"hi_{v}_{k}"]) for k in range(len(targets)) if counts[v])
        joined: list[tuple[float, float]] = []
        for low, high in ends:
            if joined and low <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
            else:
                joined.append((low, high))
        ranges[v] = joined
    return counts, ranges


def _zone(v: str, ranges: list[tuple[float, float]]) -> Column:
    """(zone, value): odd zones are the ranges, with their values; even ones the gaps below them, without."""
    value = F.col(v)
    zone, kept = F.lit(None).cast("int"), F.lit(None).cast("double")
    for k, (low, high) in reversed(list(enumerate(ranges))):
        zone = F.when(value < low, 2 * k).when(value <= high, 2 * k + 1).otherwise(zone)
        kept = F.when(value < low, F.lit(None)).when(value <= high, value).otherwise(kept)
    return F.struct(F.lit(v).alias("name"), zone.alias("zone"), kept.alias("v"))


def _slice_of(cells: DataFrame, slices: int = SLICES) -> Column:
    """The slice of a cell (name, zone, v): split points are quantiles of the distinct values of each range."""
    points = [i / slices for i in range(1, slices)]
    shapes = (
        cells.where("v IS NOT NULL")
        .groupBy("name", "zone")
        .agg(F.percentile_approx("v", points, 20 * slices).alias("splits"))
    )
    number = F.lit(0)
    for shape in shapes.collect():  # one row per range, ``slices`` numbers each
        splits = F.lit(sorted(set(shape["splits"])))
        own = (F.col("name") == shape["name"]) & (F.col("zone") == shape["zone"])
        number = F.when(own, F.size(F.filter(splits, lambda s: s < F.col("v")))).otherwise(number)
    return number


def _pick_ranks(values: DataFrame, wanted, counts, ranges) -> DataFrame:
    """The values at the wanted ranks.

    A gap below a range is one counter, combined on the map side. A range is cut into SLICES parts at sketched quantiles of
    its own distinct values, so that parts hold about as many however the values are spread; their totals show
    which parts hold a rank, and only those are ordered value by value. The input is read once for the split points
    and once for the ranks: write a costly input first.
    """
    present = {v: targets for v, targets in wanted.items() if counts[v]}
    cells = (
        values.select(F.inline(F.array(*[_zone(v, ranges[v]) for v in present])))
        .where(F.col("zone").isNotNull())
        .groupBy("name", "zone", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sliced = cells.withColumn("slice", _slice_of(cells))

    def ranks_of(v: str) -> list[int]:
        exact = [p * (counts[v] - 1) for _, p in present[v]]
        return sorted({r for x in exact for r in (math.floor(x), math.ceil(x))})

    upto = Window.partitionBy("name").orderBy("zone", "slice")  # a few times SLICES rows per column
    totals = sliced.groupBy("name", "zone", "slice").agg(F.sum("n").alias("rows"))
    holds = F.lit(False)
    for v in present:
        for rank in ranks_of(v):
            here = (F.col("before") <= rank) & (F.col("before") + F.col("rows") > rank)
            holds = holds | ((F.col("name") == v) & here)
    hit = (
        totals.withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
        .where(holds)
        .select("name", "zone", "slice", "before")
    )
    run = Window.partitionBy("name", "zone", "slice").orderBy("v")
    ranked = (
        sliced.join(hit, ["name", "zone", "slice"])
        .withColumn("end", F.col("before") + F.sum("n").over(run))
        .withColumn("start", F.col("end") - F.col("n"))
    )

    def value_at(v: str, rank: int) -> Column:
        return F.max(F.when((F.col("name") == v) & (F.col("start") <= rank) & (F.col("end") > rank), F.col("v")))

    at_rank = ranked.agg(*[value_at(v, rank).alias(f"{v}_{rank}") for v in present for rank in ranks_of(v)])
    result = []
    for v, targets in wanted.items():
        for name, p in targets:
            if v not in present:
                result.append(F.lit(None).cast("double").alias(name))
                continue
            exact = p * (counts[v] - 1)
            low, high = F.col(f"{v}_{math.floor(exact)}"), F.col(f"{v}_{math.ceil(exact)}")
            lost = F.raise_error(F.lit(f"the rank of {name} is outside its bracket")).cast("double")
            result.append(
                F.when(low.isNull() | high.isNull(), lost)
                .otherwise(low + (high - low) * (exact - math.floor(exact)))
                .alias(name)
            )
    return at_rank.select(*result)


def percentile_of(df: DataFrame, column: Column | str, percentile: float = 50.0, name: str = "value") -> DataFrame:
    """One row with the interpolated percentile (0..100) of a column."""
    return exact_percentiles(df, {name: (column, percentile / 100)})


def percent_ranks(df: DataFrame, ranks: dict[str, str], pieces: int = 64) -> DataFrame:
    """``df`` with the percent rank (0..1) of columns, ``new name -> column``: ties share the lowest rank, null stays null.

    Distinct values are counted, cut into pieces at sketched split points, and ordered piece by piece. Only the
    piece totals (at most ``pieces`` per column) meet in one task. The split points are worked out when called.
    """
    cells = [F.struct(F.lit(name).alias("name"), finite(c).alias("v")) for name, c in ranks.items()]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where("v IS NOT NULL")
        .groupBy("name", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shapes = counts.groupBy("name").agg(
        F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 10 * pieces).alias("splits"),
        F.sum("n").alias("n"),
    )
    piece, others = F.lit(0), F.lit(0)
    for shape in shapes.collect():  # one row per column
        splits = F.array(*[F.lit(s) for s in sorted(set(shape["splits"]))])
        own = F.col("name") == shape["name"]
        piece = F.when(own, F.size(F.filter(splits, lambda s: s < F.col("v")))).otherwise(piece)
        others = F.when(own, F.lit(shape["n"] - 1)).otherwise(others)
    cut = counts.withColumn("piece", piece)
    totals = cut.groupBy("name", "piece").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy("name").orderBy("piece")
    offsets = totals.select("name", "piece", (F.sum("rows").over(upto) - F.col("rows")).alias("before"))
    below = F.col("before") + F.sum("n").over(Window.partitionBy("name", "piece").orderBy("v")) - F.col("n")
    ranked = cut.join(offsets, ["name", "piece"]).select(
        "name", "v", F.coalesce(F.try_divide(below, others), F.lit(0.0)).alias("rank")
    )
    for name, c in ranks.items():
        own = ranked.where(F.col("name") == name).select(F.col("v").alias("_v"), F.col("rank").alias(name))
        df = df.join(own, finite(c) == F.col("_v"), "left").drop("_v")
    return df
