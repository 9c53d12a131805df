"""The matrix and what follows from it."""

import pytest
from pyspark.sql import functions as F

from larder.functions import labels as L
from larder.operators import menu

MATRIX = [(1, "a", 100, 50.0), (2, "b", 90, 30.0), (3, "c", 20, 60.0), (4, "d", 15, 25.0)]


@pytest.fixture(scope="module")
def matrix(spark):
    df = spark.createDataFrame(MATRIX, "item_id int, item_name string, order_count int, price double")
    return menu.menu_matrix(df.withColumn("revenue", F.col("price") * F.col("order_count"))).cache()


def test_example(matrix):
    got = {r["item_id"]: r["category"] for r in matrix.collect()}
    assert got == {1: L.STAR, 2: L.PLOWHORSE, 3: L.PUZZLE, 4: L.DOG}


@pytest.mark.parametrize(
    "orders,price,expected",
    [
        (100.0, 50.0, L.STAR),
        (100.0, 30.0, L.PLOWHORSE),
        (50.0, 50.0, L.PUZZLE),
        (50.0, 30.0, L.DOG),
        (80.0, 40.0, L.STAR),
        (None, 50.0, L.PUZZLE),
        (100.0, float("nan"), L.PLOWHORSE),
    ],
)
def test_fixed_thresholds(spark, orders, price, expected):
    items = spark.createDataFrame([(1, orders, price)], "item_id int, order_count double, price double")
    edges = spark.createDataFrame([(80.0, 40.0)], "popularity double, profitability double")
    assert menu.menu_matrix(items, edges).first()["category"] == expected


def test_metrics_list_all_categories(matrix):
    only_stars = matrix.where(F.col("category") == L.STAR)
    rows = {r["category"]: r for r in menu.menu_category_metrics(only_stars).collect()}
    assert set(rows) == set(L.MENU_CATEGORIES)
    assert rows[L.STAR]["pct_items"] == 100 and rows[L.STAR]["pct_revenue"] == 100
    assert rows[L.DOG]["item_count"] == 0 and rows[L.DOG]["total_revenue"] == 0


def test_metrics_without_revenue(matrix):
    rows = menu.menu_category_metrics(matrix.withColumn("revenue", F.lit(0.0))).collect()
    assert {r["pct_revenue"] for r in rows} == {0.0}


def test_top_items(matrix):
    assert [r["item_id"] for r in menu.category_top_items(matrix, "STAR").collect()] == [1]
    with pytest.raises(ValueError):
        menu.category_top_items(matrix, "pony")


def test_recommendations(matrix):
    rows = menu.menu_recommendations(matrix).collect()
    assert [r["priority"] for r in rows] == [1, 2, 3, 4]
    assert rows[3]["expected_impact"] == "-25% waste"
    grouped = menu.recommendations_by_category(matrix, "pu").collect()
    assert [(r["category"], r["items_affected"]) for r in grouped] == [(L.PUZZLE, 1)]


def test_pricing(matrix):
    row = menu.pricing_suggestions(matrix).collect()
    assert len(row) == 1 and row[0]["suggested_price"] == 33.6
    assert row[0]["revenue_gain"] == pytest.approx(324.0)
    view = menu.pricing_view(menu.pricing_suggestions(matrix)).first()
    assert view["price_change"] == pytest.approx(3.6) and view["price_change_pct"] == pytest.approx(12.0)


def test_browse(matrix):
    assert menu.browse_items(matrix, limit=2).count() == 2
    assert [r["item_id"] for r in menu.browse_items(matrix, "dog").collect()] == [4]
    assert menu.browse_items(matrix, min_orders=90).count() == 2
    first = [r["item_id"] for r in menu.browse_items(matrix, limit=2).collect()]
    pages = first + [r["item_id"] for r in menu.browse_items(matrix, limit=5000, after=first[-1]).collect()]
    assert pages == sorted(r["item_id"] for r in matrix.collect())


def test_performance_skips_unpriced(spark):
    ordered = spark.createDataFrame(
        [(1, 1, "a", 3), (2, 1, "a", 4), (1, 2, "b", 5), (1, 3, "c", 0), (1, None, "d", 5), (1, 9, "e", 1)],
        "place_id int, item_id int, item_name string, order_count long",
    )
    items = spark.createDataFrame([(1, 10.0), (2, float("nan")), (3, 5.0)], "id int, price double")
    rows = menu.item_performance(ordered, items).collect()
    assert [tuple(r) for r in rows] == [(1, "a", 7, 10.0, 70.0)]


def test_histogram_of_equal_prices(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "price double")
    rows = menu.price_histogram(df).orderBy("bin").collect()
    assert len(rows) == 50 and rows[25]["items"] == 4
    assert rows[0]["bin_start"] == 4.5 and rows[49]["bin_end"] == pytest.approx(5.5)


def test_price_bands(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.01,), (200.0,), (200.5,), (None,)], "price double")
    assert {r["band"]: r["items"] for r in menu.price_bands(df).collect()} == {
        "0-25": 1,
        "26-50": 1,
        "151-200": 1,
        "200+": 1,
    }


def test_new_items(spark):
    edges = spark.createDataFrame([(73.0, 40.0)], "popularity double, profitability double")
    items = spark.createDataFrame([(1, 50.0, 0.1), (2, 50.0, 0.09), (3, 10.0, None)], "item_id int, price double, daily_demand double")
    got = {r["item_id"]: r["category"] for r in menu.classify_new_items(items, edges).collect()}
    assert got == {1: L.STAR, 2: L.PUZZLE, 3: L.DOG}
