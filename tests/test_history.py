"""As-of and interval joins, snapshot differences and totals over several keys, against plain versions."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import changes, rollups, validity
from larder.registry import history

BEGIN = datetime(2020, 1, 1)


def _day(n):
    return None if n is None else BEGIN + timedelta(hours=n)


def test_as_of_against_a_scan(spark):
    draw = random.Random(1)
    key = lambda: 1 if draw.random() < 0.4 else draw.choice([None, *range(2, 9)])
    facts = [(i, key(), draw.choice([None, *[draw.randrange(20_000)] * 20])) for i in range(3000)]
    dated = [(draw.choice([None, 1, 1, 2, 3, 4, 5]), draw.choice([None, *[draw.randrange(0, 18_000, 50)] * 20]), draw.randrange(5), f"v{i}") for i in range(300)]
    got = validity.as_of(
        spark.createDataFrame([(i, k, _day(h)) for i, k, h in facts], "id long, k long, placed timestamp"),
        spark.createDataFrame([(k, _day(h), n, v) for k, h, n, v in dated], "k long, since timestamp, n int, v string"),
        "k", "placed", "since", bucket_days=30, tie="n",
    )
    assert got.columns == ["id", "k", "placed", "since", "n", "v"]
    want = {}
    for i, k, h in facts:
        able = [(since, n, v) for key_, since, n, v in dated if None not in (k, h, key_, since) and key_ == k and since <= h]
        best = max(able, default=(None, None, None))
        want[i] = (k, _day(h), _day(best[0]), best[1], best[2])
    assert {r.id: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(facts)


def test_as_of_on_empty_tables(spark):
    facts = spark.createDataFrame([(1, 1, BEGIN)], "id long, k long, placed timestamp")
    dated = spark.createDataFrame([], "k long, since timestamp, v string")
    assert [tuple(r) for r in validity.as_of(facts, dated, "k", "placed", "since").collect()] == [(1, 1, BEGIN, None, None)]
    assert validity.as_of(facts.limit(0), dated, "k", "placed", "since").count() == 0


def test_in_force_against_a_scan(spark):
    draw = random.Random(2)
    facts = [(i, draw.choice([None, 1, 1, 1, 2, 3]), draw.choice([None, *[draw.randrange(10_000)] * 9])) for i in range(2000)]
    periods = []
    for c in range(60):
        start = draw.choice([None, draw.randrange(9000), draw.randrange(9000)])
        length = draw.choice([None, 0, -5, 1, 24, 24 * 30, 24 * 200])
        periods.append((c, draw.choice([None, 1, 2, 3]), start, None if start is None or length is None else start + length))
    got = validity.in_force(
        spark.createDataFrame([(i, k, _day(h)) for i, k, h in facts], "id long, k long, placed timestamp"),
        spark.createDataFrame([(c, k, _day(a), _day(b)) for c, k, a, b in periods], "c long, k long, starts timestamp, ends timestamp"),
        "k", "placed", "starts", "ends",
    )
    want = sorted(
        (i, c) for i, k, h in facts for c, k2, a, b in periods
        if k is not None and h is not None and k == k2 and (a is None or a <= h) and (b is None or h < b)
    )
    assert sorted((r.id, r.c) for r in got.collect()) == want and got.columns == ["id", "k", "placed", "c", "starts", "ends"]


def test_validity_plans(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (history.va1(tables), history.va2(tables)):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4MB")


def test_an_open_period_stands_once(spark, monkeypatch):
    """Whatever its length, a period that never ends is one row on its side of the join."""
    seen = []
    given = validity.F.explode
    monkeypatch.setattr(validity.F, "explode", lambda c: seen.append(c) or given(c))
    facts = spark.range(5000).select("id", F.lit(1).alias("k"), (F.lit(BEGIN) + F.make_dt_interval(F.col("id").cast("int") % 4000)).alias("placed"))
    periods = spark.createDataFrame([(1, 1, _day(0), None), (2, 1, _day(0), _day(24 * 3999)), (3, 1, _day(24), _day(48))], "c long, k int, starts timestamp, ends timestamp")
    got = validity.in_force(facts, periods, "k", "placed", "starts", "ends")
    assert dict(got.groupBy("c").count().collect()) == {1: 5000, 2: 4999, 3: 2} and len(seen) == 1
    short = got._jdf.queryExecution().optimizedPlan().toString()
    assert short.count("Generate explode") == 1


def test_campaigns_at_orders_against_pairs(spark, monkeypatch):
    """Ties, repeated ids and campaigns, nulls everywhere; orders are never paired with campaigns."""
    monkeypatch.setattr(validity, "in_force", None)
    draw = random.Random(3)
    orders = [(draw.choice([None, *[draw.randrange(900)] * 30]), draw.choice([None, 1, 1, 1, 2, 3]), draw.choice([None, *[draw.randrange(9000)] * 9])) for _ in range(1200)]
    campaigns = []
    for c in range(150):
        start = draw.choice([None, draw.randrange(9000), draw.randrange(9000)])
        length = draw.choice([None, 0, -5, 1, 24, 24 * 30, 24 * 200])
        row = (draw.choice([c, c, None]), draw.choice([None, 1, 2, 4]), draw.choice([None, 5, 6, 7]), start, None if None in (start, length) else start + length)
        campaigns += [row] * draw.choice([1, 1, 2])
    got = validity.campaign_at_order(
        spark.createDataFrame([(i, k, _day(h)) for i, k, h in orders], "id long, place_id long, placed timestamp"),
        spark.createDataFrame([(c, k, d, _day(a), _day(b)) for c, k, d, a, b in campaigns], "campaign_id long, place_id long, discount int, starts timestamp, ends timestamp"),
    )
    met = Counter()
    best = {}
    low = lambda v: (v is not None, v or 0)
    for i, k, h in orders:
        for c, k2, d, a, b in campaigns:
            if None not in (i, k, h) and k == k2 and (a is None or a <= h) and (b is None or h < b):
                met[i] += 1
                best[i] = max(best.get(i, (low(None), low(None))), (low(d), low(None if c is None else -c)))
    plain = lambda v: v[1] if v[0] else None
    want = []
    for i, k, _ in orders:
        d, c = (plain(v) for v in best.get(i, (low(None), low(None))))
        want.append((i, k, met[i], None if c is None else -c, d))
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_moments_grow_with_the_periods_alone(spark):
    """A thousand periods that all overlap: two moments each, whose count is right; none is held for every other."""
    periods = spark.range(1000).select(F.lit(1).alias("k"), (F.lit(BEGIN) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("starts"), (F.lit(BEGIN) + F.make_dt_interval(F.lit(200), F.col("id").cast("int"))).alias("ends"), "id")
    rows = validity.standing(periods, "k", "starts", "ends", F.col("id")).orderBy("since").collect()
    assert [r.periods for r in rows] == [*range(1, 1001), *range(999, -1, -1)]
    assert [r.best for r in rows] == [*range(1000), *[999] * 999, None]


def _snapshots(spark, seed):
    draw = random.Random(seed)
    row = lambda: (draw.choice([None, *range(6)]), draw.choice([None, "a", "b"]), draw.choice([None, 1.5, 2.0]))
    old = [row() for _ in range(draw.randrange(40))]
    new = [r for r in old if draw.random() < 0.7] + [row() for _ in range(draw.randrange(10))]
    schema = "k int, name string, price double"
    return old, new, spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)


@pytest.mark.parametrize("seed", range(4))
def test_differences_keep_multiplicities(spark, seed):
    old, new, a, b = _snapshots(spark, seed)
    found = changes.row_changes(a, b)
    counted = Counter(tuple(r) for r in found.collect())
    plus, minus = Counter(new) - Counter(old), Counter(old) - Counter(new)
    assert counted == Counter({("added", *k): n for k, n in plus.items()}) + Counter({("removed", *k): n for k, n in minus.items()})
    assert Counter(tuple(r) for r in changes.apply_changes(a, found).collect()) == Counter(new)
    assert Counter(tuple(r) for r in changes.unchanged_rows(a, b).collect()) == Counter(old) & Counter(new)


@pytest.mark.parametrize("seed", range(4))
def test_field_changes_against_pairs(spark, seed):
    old, new, a, b = _snapshots(spark, seed)
    order = lambda r: [(v is not None, v if v is not None else 0) for v in r[1:]]
    want = []
    for key in {r[0] for r in old + new}:
        one, two = (sorted((r for r in rows if r[0] == key), key=order) for rows in (old, new))
        for i in range(max(len(one), len(two))):
            x, y = (rows[i] if i < len(rows) else None for rows in (one, two))
            fields = [n for j, n in ((1, "name"), (2, "price")) if (x[j] if x else None) != (y[j] if y else None)]
            if x is None or y is None or fields:
                want.append((key, i + 1, "added" if x is None else "removed" if y is None else "changed", fields))
    got = [(r.k, r.copy, r.change, r.fields) for r in changes.field_changes(a, b, ["k"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_totals_keep_null_keys_apart(spark):
    lines = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 1, 7.0), (1, 10, 2, 1.0), (2, 12, 1, 2.0), (3, 10, 1, 4.0)], "order_id long, item_id long, quantity int, total_cost double")
    orders = spark.createDataFrame([(1, 7, 0), (2, None, 0), (3, 7, 86400 * 40)], "id long, place_id long, created long")
    items = spark.createDataFrame([(10, "x"), (11, None)], "id long, category string")
    rows = {(r.place_id, r.category, str(r.month)[:7], r.all_place_id, r.all_category, r.all_month): (r.revenue, r.orders) for r in rollups.sales_cube(rollups.sales_cells(lines, orders, items)).collect()}
    assert rows[None, None, "None", 1, 1, 1] == (19.0, 3)
    assert rows[None, None, "None", 0, 1, 1] == (2.0, 1)  # a place nobody knows is not the total
    assert rows[None, None, "None", 1, 0, 1] == (9.0, 2) and rows[None, "x", "None", 1, 0, 1] == (10.0, 2)
    assert rows[7, None, "1970-01", 0, 1, 0] == (13.0, 1) and rows[7, "x", "1970-01", 0, 0, 0] == (6.0, 1)
    assert rollups.sales_rollup(rollups.sales_cells(lines.limit(0), orders, items)).count() <= 1


def test_lines_are_scanned_once_for_all_totals(spark, tables):
    plan = rollups.sales_cube(history.cells(tables))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("l_extendedprice") and initial.count("lineitem.parquet") <= 1 and initial.count("Expand") == 1
