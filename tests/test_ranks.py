"""Exact percentiles and ranks against numpy and pandas, the narrowing path included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.functions.ranks import exact_percentiles, percent_ranks, percentile_of


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"v": np.asarray(values, dtype=float)})).repartition(7)


@pytest.mark.parametrize("values,p,expected", [([1, 2, 3, 4, 5], 50, 3.0), (range(1, 11), 25, 3.25), (range(1, 11), 50, 5.5)])
def test_small(spark, values, p, expected):
    assert percentile_of(frame(spark, list(values)), "v", p).first()[0] == pytest.approx(expected)


def test_empty_is_null(spark):
    assert percentile_of(spark.createDataFrame([], "v double"), "v").first()[0] is None
    rows = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert percentile_of(rows, "v").first()[0] is None


SHAPES = {
    "uniform": lambda g: g.uniform(-1e6, 1e6, 20_000),
    "heavy tail": lambda g: np.exp(g.normal(0, 4, 20_000)),
    "a third equal": lambda g: np.where(g.random(20_000) < 0.34, 7.0, g.normal(7, 3, 20_000)),
    "few values": lambda g: g.integers(0, 5, 20_000).astype(float),
    "all equal": lambda g: np.full(20_000, 3.5),
    "sorted": lambda g: np.arange(20_000, dtype=float),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_narrowed(spark, shape):
    """With accuracy 100 more than 10 000 values take the narrowing path."""
    values = SHAPES[shape](np.random.default_rng(5))
    fractions = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = frame(spark, np.concatenate([values, [np.nan, np.inf]]))
    got = exact_percentiles(df, {n: ("v", p) for n, p in fractions.items()}, accuracy=100).first()
    for name, p in fractions.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9), name


def test_narrowed_with_an_empty_column(spark):
    df = frame(spark, np.arange(20_001.0)).withColumn("none", F.lit(None).cast("double"))
    got = exact_percentiles(df, {"m": ("v", 0.5), "n": ("none", 0.5)}, accuracy=100).first()
    assert (got["m"], got["n"]) == (10_000.0, None)


@pytest.mark.parametrize("pieces", [2, 7, 256])
def test_percent_ranks(spark, pieces):
    g = np.random.default_rng(3)
    values = np.where(g.random(3000) < 0.34, 5, g.integers(0, 400, 3000)).astype(float)
    got = percent_ranks(frame(spark, values), {"rank": "v"}, pieces).toPandas()
    series = pd.Series(values)
    expected = dict(zip(series, (series.rank(method="min") - 1) / (len(series) - 1)))
    assert len(got) == 3000
    assert np.allclose(got["rank"], got["v"].map(expected))


def test_percent_rank_of_one_row_and_null(spark):
    rows = percent_ranks(spark.createDataFrame([(1.0,), (None,)], "v double"), {"rank": "v"}).collect()
    assert {(r["v"], r["rank"]) for r in rows} == {(1.0, 0.0), (None, None)}


@pytest.mark.parametrize("shape", ["heavy tail", "sorted", "uniform"])
def test_slices_hold_about_as_many_values(spark, shape):
    from larder.functions.ranks import _slice_of

    values = np.sort(SHAPES[shape](np.random.default_rng(5)))
    cells = frame(spark, values).select(F.lit("v").alias("name"), F.lit(1).alias("zone"), "v").distinct()
    held = [r["count"] for r in cells.groupBy(_slice_of(cells, 32).alias("slice")).count().collect()]
    assert len(held) == 32 and max(held) < 3 * sum(held) / 32
