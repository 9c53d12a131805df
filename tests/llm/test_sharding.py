import random
import zlib

import pytest

from larder.llm import sharding
from larder.llm.sharding import fill_up, op9, place_groups, place_records, shard_documents, share_out


def _check(rows, shards, total_rows):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == total_rows and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_sizes_are_near_equal_and_order_is_kept(spark, hot):
    draw = random.Random(5)
    rows = [(7 if draw.random() < hot else draw.randrange(10**9), i, draw.randrange(1, 200)) for i in range(20_000)]
    placed = place_records(spark.createDataFrame(rows, "key long, id long, size long"), 10).collect()
    _check(placed, 10, 20_000)
    sizes = [sum(r.size for r in placed if r.shard == s) for s in range(10)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 10
    ordered = sorted(placed, key=lambda r: (r.key, r.id))
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in placed)


def test_small_groups_stay_whole(spark):
    rows = [(i // 5, i, 100) for i in range(20_000)]
    placed = place_records(spark.createDataFrame(rows, "key long, id long, size long"), 8).collect()
    of_key = {}
    for r in placed:
        of_key.setdefault(r.key, set()).add(r.shard)
    assert all(len(s) == 1 for s in of_key.values())


def test_rows_of_every_kind(spark):
    rows = [(1, "a", 1, 2), (1, "a", 1, 2), (None, None, 3, 4), (2, "", None, 9), (3, "é" * 100_000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, row int")
    got = shard_documents(docs, 3).collect()
    _check(got, 3, 5)
    assert got[0].__fields__ == ["doc_id", "size", "text_crc32", "shard", "slot"]
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert (None, 16, 0) in sizes and (2, 16, 0) in sizes and (1, 17, zlib.crc32(b"a")) in sizes and (3, 200_016, zlib.crc32("é".encode() * 100_000)) in sizes
    strings = spark.createDataFrame([("b", 1, 1), (None, 2, 1), ("a", None, None)], "key string, id long, size long")
    _check(place_records(strings, 2).collect(), 2, 3)


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_more_shards_than_rows(spark):
    rows = [(i, i, 10) for i in range(3)]
    _check(place_records(spark.createDataFrame(rows, "key long, id long, size long"), 40).collect(), 40, 3)


def test_share_out_and_fill_up():
    assert share_out([5, 3, 3, 2, 2, 1], 2) == [0, 1, 1, 0, 1, 0]
    assert fill_up([4, 1, 9], 6) == [1.5, 4.5, 0] and fill_up([0, 0], 3) == [1.5, 1.5] and fill_up([7], 2) == [2.0]
    draw = random.Random(3)
    for _ in range(50):
        loads, more = [draw.randrange(100) for _ in range(draw.randint(1, 9))], draw.randrange(300)
        room = fill_up(loads, more)
        levels = [a + b for a, b in zip(loads, room)]
        assert abs(sum(room) - more) < 1e-6 and all(b == 0 or abs(x - min(levels)) < 1e-6 for x, b in zip(levels, room))


def _plain_placement(rows, shards, small_group=0.02, ranges_per_shard=8):
    """The law of place_groups in one process: (load of each shard, shards of each key)."""
    held = {}
    for key, _, size in rows:
        held[key] = held.get(key, 0) + size
    total = sum(held.values())
    target, least = total / shards, min(small_group * total / shards, 2 * total / (shards * ranges_per_shard))
    loads, of_key = [0.0] * shards, {}
    portions = [(h / -(-h // target), k) for k, h in held.items() if h > least for _ in range(int(-(-h // target)))]
    for size, key in sorted(portions, key=lambda p: -p[0]):
        s = loads.index(min(loads))
        loads[s] += size
        of_key.setdefault(key, set()).add(s)
    room = fill_up(loads, sum(h for h in held.values() if h <= least))
    return [a + b for a, b in zip(loads, room)], target, least


@pytest.mark.parametrize("seed, hot, keys", [(1, 0.0, 40), (2, 0.35, 3000), (3, 0.1, 200), (4, 0.34, 10**9)])
def test_groups_against_a_plain_placement(spark, seed, hot, keys):
    draw = random.Random(seed)
    rows = [(7 if draw.random() < hot else draw.randrange(keys), i, draw.randrange(1, 200)) for i in range(8000)]
    placed = place_groups(spark.createDataFrame(rows, "key long, id long, size long"), 8).collect()
    _check(placed, 8, 8000)
    assert sorted((r.key, r.id, r.size) for r in placed) == sorted(rows)
    want, target, least = _plain_placement(rows, 8)
    loads, of_key, held = [0] * 8, {}, {}
    for r in placed:
        loads[r.shard] += r.size
        held[r.key] = held.get(r.key, 0) + r.size
        of_key.setdefault(r.key, set()).add(r.shard)
    assert all(len(s) == 1 for k, s in of_key.items() if held[k] <= target)
    assert all(abs(a - b) <= 2 * least + 400 for a, b in zip(sorted(loads), sorted(want)))


def test_groups_with_one_key_only_and_without_any_size(spark):
    one = place_groups(spark.createDataFrame([(5, i, 10) for i in range(1000)], "key long, id long, size long"), 4).collect()
    _check(one, 4, 1000)
    assert sorted(sum(r.size for r in one if r.shard == s) for s in range(4)) == [2500] * 4
    none = place_groups(spark.createDataFrame([("a", 1, 0), (None, 2, None)], "key string, id long, size long"), 4).collect()
    _check(none, 4, 2)
    named = place_groups(spark.createDataFrame([("é" if i % 2 else "z", i, 10) for i in range(100)], "key string, id long, size long"), 2).collect()
    _check(named, 2, 100)
    assert {len({r.shard for r in named if r.key == k}) for k in ("é", "z")} == {1}


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    rows = [(i // 2, i, 10) for i in range(3000)]
    seen = []
    given = sharding._positions
    monkeypatch.setattr(sharding, "_positions", lambda slim, total, pieces, *a, **k: seen.append(pieces) or given(slim, total, pieces, *a, **k))
    placed = place_groups(spark.createDataFrame(rows, "key long, id long, size long"), 2, rows_per_range=100).collect()
    _check(placed, 2, 3000)
    assert seen[-1] == 30


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_keeps_the_laws(spark, sf):
    """Sizes, checksums and slots recomputed; equal texts together unless they outweigh a shard; sizes near equal."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op9(spark, f"/root/testdata/{sf}").collect()
    _check(got, 40, len(docs))
    data = {d: (t or "").encode() for d, t in docs}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d, len(t) + 16, zlib.crc32(t)) for d, t in data.items()}
    mean = sum(r.size for r in got) / 40
    loads, of_text, held = [0] * 40, {}, {}
    for r in got:
        loads[r.shard] += r.size
        of_text.setdefault(data[r.doc_id], set()).add(r.shard)
        held[data[r.doc_id]] = held.get(data[r.doc_id], 0) + r.size
    assert all(len(s) == 1 for t, s in of_text.items() if held[t] <= mean)
    rest = [h for h in held.values() if h <= mean]
    assert max(loads) <= max(1.05 * mean, max(rest)) if sf == "sf0.01" else max(loads) <= mean + max(rest)
