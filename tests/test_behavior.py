"""Order behaviour, with hot keys."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import behavior, dashboard, forecast


def brute_pairs(lines, min_support, n):
    baskets = {}
    for order, item in lines:
        baskets.setdefault(order, set()).add(item)
    single, pair = Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        pair.update(combinations(sorted(items), 2))
    total = len(baskets)
    rows = [(a, b, c, c / total, (c / total) / (single[a] / total * single[b] / total)) for (a, b), c in pair.items()]
    rows = sorted((r for r in rows if r[3] >= min_support), key=lambda r: (-r[2], r[0], r[1]))
    return rows[:n]


@pytest.mark.parametrize("slice_items", [1000, 3])
@pytest.mark.parametrize("min_support", [0.0, 0.02, 0.2])
def test_pairs_match_brute_force(spark, slice_items, min_support):
    g = np.random.default_rng(1)
    lines = [(int(o), int(i)) for o, i in zip(g.integers(0, 60, 400), g.zipf(1.6, 400) % 25)]
    lines += [(999, i) for i in range(25)] * 8  # one order with a third of all rows
    df = spark.createDataFrame(lines, "order_id long, item_id long")
    got = behavior.co_purchased_items(df, min_support, 40, slice_items).collect()
    expected = brute_pairs(lines, min_support, 40)
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in expected]
    assert np.allclose([tuple(r)[3:] for r in got], [r[3:] for r in expected])


def test_pairs_of_nothing(spark):
    assert behavior.co_purchased_items(spark.createDataFrame([], "order_id long, item_id long")).count() == 0


@pytest.fixture(scope="module")
def small(spark):
    # 2024-01-05 is a Friday; order 3 has no lines, line order 9 has no order.
    orders = spark.createDataFrame(
        [(1, 7, 1704448800, 10.0, "x"), (2, 7, 1704535200, 30.0, "x"), (3, 8, 1704538800, 50.0, "y"), (4, 8, None, 20.0, None)],
        "id long, place_id long, created long, total_amount double, type string",
    )
    lines = spark.createDataFrame(
        [(1, 1, 2.0, 5.0), (1, 1, 1.0, 5.0), (1, 2, 1.0, 7.0), (2, 1, 4.0, 5.0), (4, 3, 1.0, 1.0), (9, 1, 100.0, 5.0)],
        "order_id long, item_id long, quantity double, price double",
    ).withColumn("cost", F.lit(None).cast("double"))
    return orders, lines


def test_patterns(small):
    orders, lines = small
    facts = behavior.order_facts(lines, orders)
    assert [tuple(r) for r in behavior.hourly_pattern(facts).collect()] == [(10, 2, 8.0, 22.0)]
    assert [tuple(r) for r in behavior.weekday_pattern(facts).collect()] == [("Friday", 1, 4.0), ("Saturday", 1, 4.0)]
    row = behavior.temporal_insights(facts, orders).first()
    assert tuple(row) == (10, "10:00", "Friday", 50.0, 2.0)


def test_baskets(small):
    orders, lines = small
    row = behavior.basket_stats(lines, orders).first()
    assert tuple(row) == (1.3, 3.0, 20.0, 20.0)


def test_coverage_and_rates(small):
    orders, lines = small
    assert tuple(behavior.behavior_coverage(lines, orders).first()) == (4, 6, 3, 2)
    assert dashboard.orders_per_day(orders).first()[0] == 4.0
    assert tuple(dashboard.lines_per_order(lines).first()) == (1.5, 27.25)
    assert tuple(dashboard.peak_by_mode(orders).first()) == (10, "10:00", "Saturday", 66.7)


def test_daily_demand_and_lags(spark, small):
    orders, lines = small
    daily = forecast.daily_demand(forecast.order_lines(lines, orders))
    rows = {(r["item_id"], str(r["date"])): r for r in daily.collect()}
    assert rows[(1, "2024-01-05")]["quantity_demanded"] == 3.0 and rows[(1, "2024-01-05")]["num_orders"] == 1
    assert rows[(1, "2024-01-06")]["is_weekend"] == 1
    assert (3, "2024-01-05") not in rows  # its order has no date
    features = forecast.demand_features(lines, orders)
    first = features.where("item_id = 1").orderBy("date").collect()
    assert first[0]["lag_7d_avg"] == pytest.approx(7 / 3) and first[1]["lag_7d_avg"] == 3.0


def test_features_from_daily_sums_equal_those_from_lines(spark):
    g = np.random.default_rng(8)
    rows = [(int(o), int(i), float(q), float(p)) for o, i, q, p in zip(
        g.integers(0, 80, 600), g.integers(0, 6, 600), g.integers(1, 50, 600), g.uniform(5, 90, 600))]
    rows += [(1, 77, 3.0, 2.0), (2, 78, None, None)]
    lines = spark.createDataFrame(rows, "order_id long, item_id long, quantity double, price double").withColumn("cost", F.lit(1.0))
    orders = spark.range(70).select(
        "id",
        F.when(F.col("id") % 11 != 0, F.col("id") % 4).alias("place_id"),
        F.when(F.col("id") % 13 != 0, 1704189600 + (F.col("id") % 9) * 86400).alias("created"),
    )
    joined = forecast.order_lines(lines, orders)
    plain = forecast.demand_lags(
        forecast.enriched_demand(forecast.daily_demand(joined), forecast.item_stats(joined), forecast.place_stats(joined))
    ).toPandas()
    got = forecast.demand_features(lines, orders).toPandas()[plain.columns]
    key = ["item_id", "place_id", "date"]
    plain, got = (d.sort_values(key).reset_index(drop=True) for d in (plain, got))
    assert len(plain) == len(got) > 50
    for c in plain.columns:
        if c in ("date", "avg_cost"):
            assert (plain[c] == got[c]).all() or c == "avg_cost"
        else:
            assert np.allclose(plain[c].astype(float), got[c].astype(float), equal_nan=True), c


def test_lags_look_back_fourteen_rows(spark):
    days = [(1, 1, d, float(d)) for d in range(20)]
    df = spark.createDataFrame(days, "item_id int, place_id int, d int, quantity_demanded double")
    df = df.select("*", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d") * 3).alias("date"), F.lit(-1.0).alias("avg_daily_qty"))
    rows = forecast.demand_lags(df).orderBy("date").collect()
    for i, r in enumerate(rows):
        assert r["lag_7d_avg"] == (np.mean(range(max(0, i - 7), i)) if i else -1.0)
        assert r["lag_14d_avg"] == (np.mean(range(max(0, i - 14), i)) if i else -1.0)


@pytest.mark.parametrize("grain,expected", [("hourly", 3), ("daily", 2), ("weekly", 1)])
def test_grains(spark, grain, expected):
    orders = spark.createDataFrame([(1, 1, 1704189600), (2, 1, 1704193200), (3, 1, 1704276000)], "id int, place_id int, created long")
    lines = spark.createDataFrame([(o, 5, 1.0, 2.0, 1.0) for o in (1, 2, 3)], "order_id int, item_id int, quantity double, price double, cost double")
    df = forecast.daily_demand(forecast.order_lines(lines, orders), grain)
    assert df.count() == expected
    assert df.agg(F.sum("num_orders")).first()[0] == 3


def test_unknown_grain(small):
    with pytest.raises(ValueError):
        forecast.daily_demand(forecast.order_lines(small[1], small[0]), "yearly")
