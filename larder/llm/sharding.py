"""Sharding by sampled splitters: near equal shards.

1. Key, size and a stable row number of every record are written once; later passes read only these slim rows.
2. Records are sampled with a chance in proportion to size; quantiles of the sample become splitters.
3. Records are dealt into the ranges between splitters. The first splitters are keys, so records with one key share a
   range; a range that is too full (a hot key, or bad luck in the sample) is sampled again and split at (key, id, row),
   which can separate any two records, until no range is too full.
4. Running sizes inside each range, on top of the ranges' prefix sums, give every record its exact position in the
   whole order.

``place_records`` cuts that order into equal parts: shards are contiguous in the key. ``place_groups`` keeps the records of a
key together, in a shard of its choice. Keys that hold more than a few per cent of a shard are placed first, the largest into the
emptiest shard; only a key that is larger than a shard is cut, at exact positions. The other keys fill up what is left
of each shard, in the order of the splitters.

The driver sees the samples, one row per range and one row per large key. Ranges grow with the data only to keep the
records of one range sortable in a task (``rows_per_range``); the others are bounded by the number of shards.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.columns import load, needs
from larder.llm.registered import query
from larder.session import written

_GRAIN = 1 << 30  # of the sampling draw
_LEAST = -(1 << 63)
_FIELDS = ("key", "id", "row")


def _sample(rows: DataFrame, wanted_per_byte: float, turn: int) -> DataFrame:
    """Records drawn with a chance of size * wanted_per_byte. The draw hashes the written row number: a retried task
    draws the same records."""
    draw = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(_GRAIN)).cast("double")
    return rows.where(draw < F.col("size").cast("double") * F.lit(wanted_per_byte * _GRAIN))


def _quantiles(ordered: list, pieces: int) -> list:
    return list(dict.fromkeys(ordered[len(ordered) * i // pieces] for i in range(1, pieces))) if ordered else []


def _range_of(cuts: list[tuple]) -> Column:
    """How many of the sorted splitters are at or below a record: first among block heads, then inside one block."""
    if not cuts:
        return F.lit(0)
    fan = max(2, math.isqrt(len(cuts)))
    value = F.struct(*_FIELDS)

    def table(part: list[tuple]) -> Column:
        return F.arrays_zip(*[F.lit([c[i] for c in part]).alias(f) for i, f in enumerate(_FIELDS)])

    block = F.size(F.filter(table(cuts[::fan]), lambda s: s <= value))
    inside = F.size(F.filter(F.slice(table(cuts), (F.greatest(block, F.lit(1)) - 1) * fan + 1, fan), lambda s: s <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * fan + inside)


def _slim(records: DataFrame) -> DataFrame:
    """The records with key, id and size made sound, and a row number; written once."""
    needs(records, *_FIELDS[:2], "size")
    kind = dict(records.dtypes)["key"]
    least = F.lit("") if kind == "string" else F.lit(_LEAST)
    return written(
        records.withColumns(
            {
                "key": F.coalesce("key" if kind == "string" else F.col("key").cast("long"), least),
                "id": F.coalesce(F.col("id").cast("long"), F.lit(_LEAST)),
                "size": F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)),
                "row": F.monotonically_increasing_id(),
            }
        ),
        "records",
    )


def _ranges(slim: DataFrame, total: int, pieces: int, samples_per_range: int, only_keys: bool = False) -> tuple[DataFrame, dict, list[tuple]]:
    """(the records with their range, each range's sums, the splitters). ``only_keys``: no splitter falls inside a key."""
    fullest = max(4 * total / pieces, 1)
    drawn = _sample(slim, pieces * samples_per_range / max(total, 1), 0).select(*_FIELDS).collect()
    cuts = [(k, _LEAST, _LEAST) for k in _quantiles(sorted(r["key"] for r in drawn), pieces)]
    for turn in range(1, 65):
        dealt = slim.withColumn("range", _range_of(cuts))
        held = dealt.groupBy("range").agg(
            F.sum("size").alias("held"), F.count("*").alias("rows"), F.max("size").alias("largest"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        ranges = {r["range"]: r for r in held.collect()}
        overfull = [r for r in ranges.values() if r["held"] - r["largest"] > fullest and not (only_keys and r["low"] == r["high"])]
        if not overfull:
            return dealt, ranges, cuts
        hot = dealt.where(F.col("range").isin([r["range"] for r in overfull]))
        drawn = _sample(hot, samples_per_range / fullest, turn).select("range", *_FIELDS).collect()
        for r in overfull:
            own = sorted((d["key"], _LEAST, _LEAST) if only_keys else tuple(d[f] for f in _FIELDS) for d in drawn if d["range"] == r["range"])
            cuts += _quantiles(own, math.ceil(2 * r["held"] / fullest))
        cuts = sorted(set(cuts))
    raise RuntimeError(f"{len(overfull)} ranges stay overfull")


def _positions(slim: DataFrame, total: int, pieces: int, samples_per_range: int, only_keys: bool = False) -> tuple[DataFrame, list[tuple]]:
    """(the records with range, start and rank: bytes and records before each in (key, id) order; the splitters)."""
    dealt, ranges, cuts = _ranges(slim, total, pieces, samples_per_range, only_keys)
    sizes, rows, below = [], [], (0, 0)
    for i in range(len(cuts) + 1):
        sizes.append(below[0])
        rows.append(below[1])
        if i in ranges:
            below = (below[0] + ranges[i]["held"], below[1] + ranges[i]["rows"])
    at = F.col("range") + 1
    ordered = Window.partitionBy("range").orderBy(*_FIELDS)
    running = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("start", F.element_at(F.lit(sizes), at) + running - F.col("size")).withColumn(
        "rank", F.element_at(F.lit(rows), at) + F.row_number().over(ordered) - 1
    ), cuts


def place_records(
    records: DataFrame,
    shards: int,
    ranges_per_shard: int = 8,
    samples_per_range: int = 32,
    whole_group: float = 0.02,
    rows_per_range: int = 5_000_000,
) -> DataFrame:
    """``shard`` and ``slot`` for every row of ``records`` with columns key (long or string), id (long), size (long).

    Other columns pass through. Shards are contiguous in the key; their sizes stay within ``whole_group`` of a shard around the
    mean (or within the largest record, if that is larger), so a key that holds more is cut. Slots count from 0 in (key, id) order
    inside a shard, without gaps. Null keys, ids and sizes count as the least key, the least id and 0; repeated rows get a
    slot each; an empty table gives an empty one. A corpus of size 0 goes to shard 0. Jobs run when called: slim rows and
    placed rows are written.
    """
    slim = _slim(records)
    total, count = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces = max(shards * ranges_per_shard, math.ceil(count / rows_per_range))
    dealt, cuts = _positions(slim, total, pieces, samples_per_range)
    group = Window.partitionBy("range", "key")
    split_keys = sorted({c[0] for c in cuts if c[2] != _LEAST})
    whole = F.sum("size").over(group) <= F.lit(whole_group * total / shards)
    if split_keys:
        whole &= ~F.col("key").isin(split_keys)
    placed = dealt.withColumn("start", F.when(whole, F.min("start").over(group)).otherwise(F.col("start"))).withColumn(
        "shard", F.least(F.lit(shards - 1), F.floor(F.col("start") / F.lit(max(total, 1)) * shards)).cast("int")
    )
    placed = written(placed.drop("range", "start", "row"), "placed")
    first = dict(placed.groupBy("shard").agg(F.min("rank")).collect())
    starts = F.element_at(F.lit([first.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
    return placed.withColumn("slot", F.col("rank") - starts).drop("rank")


def share_out(sizes: list[int], shards: int) -> list[int]:
    """A shard for each size: the largest first, each into the emptiest shard (the least number among equals)."""
    heap = [(0, s) for s in range(shards)]
    shard = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard[i] = heapq.heappop(heap)
        heapq.heappush(heap, (load + sizes[i], shard[i]))
    return shard


def fill_up(loads: list[int], more: int) -> list[float]:
    """How much of ``more`` each shard takes, so that the least full ones rise to one level."""
    left, level = sorted(loads), 0.0
    for n in range(1, len(left) + 1):
        level = (more + sum(left[:n])) / n
        if n == len(left) or level <= left[n]:
            break
    return [max(level - load, 0.0) for load in loads]


def _listed(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A small table from rows that the driver has worked out."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def place_groups(
    records: DataFrame,
    shards: int,
    ranges_per_shard: int = 8,
    samples_per_range: int = 32,
    small_group: float = 0.02,
    rows_per_range: int = 5_000_000,
) -> DataFrame:
    """``shard`` and ``slot`` for every row of ``records`` with columns key (long or string), id (long), size (long).

    All records of a key are in one shard, unless they outweigh a shard's mean size; those are cut into equal parts of at most
    that. Keys of more than ``small_group`` of a shard go first, the largest into the emptiest; there are at most shards /
    small_group of them. The rest fills all shards up to one level, to within ``small_group`` on either side, in key order. Slots
    count from 0 without gaps. Nulls, repeated rows and the empty table as in ``place_records``.
    """
    spark, slim = records.sparkSession, _slim(records)
    total, count = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces, target = max(shards * ranges_per_shard, math.ceil(count / rows_per_range)), total / shards
    kind = dict(slim.dtypes)["key"]
    # Half of what makes a range overfull, so that no range has to be split inside one of the small keys.
    least = min(small_group * target, 2 * total / pieces)
    held = slim.groupBy("key").agg(F.sum("size").alias("held")).where(F.col("held") > F.lit(least))
    large = sorted((r["key"], r["held"]) for r in held.collect())

    loads, offsets = [0] * shards, [0] * shards
    parts: list[DataFrame] = []
    light, others = slim, total
    if large:
        portions = [(key, i, h * (i + 1) // p - h * i // p) for key, h in large for p in [math.ceil(h / target)] for i in range(p)]
        shard = share_out([size for *_, size in portions], shards)
        at = {(key, i): s for (key, i, _), s in zip(portions, shard)}
        base, rows = 0, []
        for key, h in large:
            rows.append({"large": key, "base": base, "held": h, "cuts": math.ceil(h / target)})
            base += h
        keys = F.broadcast(_listed(spark, rows, f"large: {kind}, base: bigint, held: bigint, cuts: bigint"))
        heavy = slim.join(keys.select("large"), F.col("key") == F.col("large"), "left_semi")
        light = slim.join(keys.select("large"), F.col("key") == F.col("large"), "left_anti")
        dealt, _ = _positions(heavy, base, max(1, math.ceil(pieces * base / max(total, 1))), samples_per_range)
        within = F.least(F.expr("((start - base) * cuts) div held"), F.col("cuts") - 1)
        dealt = written(dealt.join(keys, F.col("key") == F.col("large")).withColumn("portion", within).drop("range", "start", "row", "large", "base", "held", "cuts"), "large")
        rows = []
        for r in dealt.groupBy("key", "portion").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.sum("size").alias("held")).orderBy("key", "portion").collect():
            s = at[r["key"], r["portion"]]
            rows.append({"large": r["key"], "part": r["portion"], "shard": s, "shift": offsets[s] - r["first"]})
            offsets[s] += r["n"]
            loads[s] += r["held"]
        placed = F.broadcast(_listed(spark, rows, f"large: {kind}, part: bigint, shard: int, shift: bigint"))
        dealt = dealt.join(placed, (F.col("key") == F.col("large")) & (F.col("portion") == F.col("part")))
        parts.append(dealt.withColumn("slot", F.col("rank") + F.col("shift")).drop("rank", "portion", "large", "part", "shift"))
        others = total - base

    room, ends = fill_up(loads, others), []
    for s, own in enumerate(room):
        if own > 0:
            ends.append((s, own + (ends[-1][1] if ends else 0)))
    ends = ends or [(0, 0.0)]
    dealt, _ = _positions(light, others, pieces, samples_per_range, only_keys=True)
    first = F.min("start").over(Window.partitionBy("range", "key"))
    nth = F.size(F.filter(F.lit([float(e) for _, e in ends[:-1]]), lambda e: e <= first)) if len(ends) > 1 else F.lit(0)
    dealt = written(dealt.withColumn("shard", F.element_at(F.lit([s for s, _ in ends]), nth + 1).cast("int")).drop("range", "start", "row"), "small")
    begin = dict(dealt.groupBy("shard").agg(F.min("rank")).collect())
    shift = F.element_at(F.lit([offsets[s] - begin.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
    parts.append(dealt.withColumn("slot", F.col("rank") + shift).drop("rank"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot.

    The key is a hash of the text, so copies of one text stay together unless they alone outweigh a shard. A null text has no
    bytes; its checksum is that of an empty text.
    """
    needs(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(
        F.xxhash64(text).alias("key"),
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(id_col).alias("given"),
    )
    placed = place_groups(records, shards, **settings)
    return placed.select(F.col("given").alias(id_col), "size", "text_crc32", "shard", "slot")


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
