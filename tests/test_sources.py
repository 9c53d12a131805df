"""Reading, ingesting, appending and exporting."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larder.operators import quality
from larder.sources import schemas, sinks, tables
from larder.sources.orders import append_menu_items, append_orders, append_restaurants
from larder.sources.stock import ingest_inventory, parse_stock, read_stock_csv, sku_to_inventory


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "dim_items.csv").write_text(
        'title,id,price,unused,status\n"Soup, hot",1,45.5,x,Active\nTea,2,,y,\n"say ""hi""",3,7,z,Active\n'
    )
    (tmp_path / "most_ordered.csv").write_text("place_id,item_id,item_name,order_count\n1,1,Soup,5\n")
    return str(tmp_path)


def test_load_table_by_header(spark, folder):
    df = tables.load_table(spark, folder, "dim_items")
    assert df.columns == ["id", "title", "price", "status"]
    assert dict(df.dtypes)["price"] == "double"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "Soup, hot", 45.5, "Active"),
        (2, "Tea", None, None),
        (3, 'say "hi"', 7.0, "Active"),
    ]


def test_missing_table(spark, folder):
    with pytest.raises(AnalysisException):
        tables.load_table(spark, folder, "fct_orders")


def test_catalog_skips_missing(spark, folder):
    found = tables.load_catalog(spark, folder)
    assert sorted(found) == ["dim_items", "most_ordered"]
    assert spark.sql("SELECT sum(order_count) FROM most_ordered").first()[0] == 5
    assert len(schemas.CATALOG) == 19


def test_catalog_of_parquet_with_keep(spark, folder, tmp_path):
    df = tables.load_table(spark, folder, "most_ordered")
    df.write.parquet(str(tmp_path / "p" / "most_ordered.parquet"))
    found = tables.load_catalog(spark, str(tmp_path / "p"), ["most_ordered"], "parquet", views=False, keep=True)
    assert found["most_ordered"].is_cached and found["most_ordered"].count() == 1
    found["most_ordered"].unpersist()


MESSAGES = [
    ("m1", 1, 90.0, [(5, 2, 45.0)]),
    ("m2", 1, 30.0, [(5, 1, 10.0), (6, 2, 10.0)]),
    ("m3", 2, 0.0, []),
]


def test_append_orders(spark, tmp_path):
    messages = spark.createDataFrame(MESSAGES, schemas.ORDER_MESSAGE)
    append_orders(messages, str(tmp_path), F.lit("2024-01-01 12:00:00"))
    append_orders(messages.where("order_id = 'm1'").withColumn("order_id", F.lit("m4")), str(tmp_path))
    orders = tables.load_transactional(spark, str(tmp_path), "orders", schemas.LIVE_ORDERS)
    lines = tables.load_transactional(spark, str(tmp_path), "order_items", schemas.LIVE_ORDER_ITEMS)
    assert orders.count() == 4 and lines.count() == 4
    assert orders.where("id = 'm1'").first()["timestamp"] == dt.datetime(2024, 1, 1, 12)
    got = [tuple(r) for r in lines.where("order_id = 'm2'").orderBy("line_no").collect()]
    assert got == [("m2", 0, 5, 1, 10.0), ("m2", 1, 6, 2, 10.0)]


def test_append_dimensions(spark, tmp_path):
    append_restaurants(spark.createDataFrame([(1, "Inn", "Oslo")], "id int, name string, location string"), str(tmp_path))
    items = spark.createDataFrame([(1, 1, "Soup", 9.5, "any text")], "id int, restaurant_id int, name string, price double, category string")
    append_menu_items(items, str(tmp_path))
    append_menu_items(items.withColumn("id", F.lit(2)), str(tmp_path))
    rows = tables.load_transactional(spark, str(tmp_path), "menu_items", schemas.LIVE_MENU_ITEMS)
    assert rows.count() == 2 and rows.first()["description"] is None
    with pytest.raises(ValueError, match="location"):
        append_restaurants(spark.createDataFrame([(1, "Inn")], "id int, name string"), str(tmp_path))


def stock_file(tmp_path, text):
    path = tmp_path / "stock.csv"
    path.write_text(text)
    return str(path)


def test_ingest(spark, tmp_path):
    path = stock_file(
        tmp_path, " Item_ID ,Current_Stock,REORDER_POINT\n1,5,10\n2,7.5,\nx,1,1\n3,,4\n4,8,lots\n5.9,1,2\n6,nan,1\n"
    )
    assert ingest_inventory(spark, path, str(tmp_path), F.lit("2024-01-01")) == 3
    rows = tables.load_transactional(spark, str(tmp_path), "inventory_reports", schemas.INVENTORY_REPORT)
    got = sorted((r["item_id"], r["current_stock"], r["reorder_point"], r["safety_stock"]) for r in rows.collect())
    assert got == [(1, 5.0, 10.0, 0.0), (2, 7.5, 0.0, 0.0), (5, 1.0, 2.0, 0.0)]
    _, rejected = parse_stock(read_stock_csv(spark, path), F.current_timestamp())
    assert sorted(r["item_id"] for r in rejected.collect()) == ["3", "4", "6", "x"]


def test_ingest_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="current_stock"):
        ingest_inventory(spark, stock_file(tmp_path, "item_id,stock\n1,2\n"), str(tmp_path))
    with pytest.raises(ValueError, match="no valid rows"):
        ingest_inventory(spark, stock_file(tmp_path, "item_id,current_stock\nx,2\n"), str(tmp_path))


def test_skus(spark):
    df = spark.createDataFrame([("7", 3.0, 10.0), ("n/a", 1.0, 1.0), (None, 1.0, 1.0)], "item_id string, quantity double, low_stock_threshold double")
    assert [tuple(r) for r in sku_to_inventory(df).collect()] == [(7, 3.0, 10.0, 5.0)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([((1, 2.5), "x")], "a struct<b: int, c: double>, d string")
    paths = sinks.export_menu_results({"classification": df, "pricing": df}, str(tmp_path / "m"))
    assert sorted(paths) == ["classification", "pricing"]
    back = spark.read.option("header", True).csv(paths["pricing"])
    assert [tuple(r) for r in back.collect()] == [("1", "2.5", "x")] and back.columns == ["a_b", "a_c", "d"]
    paths = sinks.export_inventory_results({k: df for k in sinks.INVENTORY_RESULTS}, str(tmp_path / "i"))
    assert os.path.basename(paths["summary"]) == "executive_summary.csv" and len(paths) == 5


def test_export_summary(spark, tmp_path):
    df = spark.createDataFrame([((1, 2.5),)], "a struct<b: int, c: double>")
    path = sinks.export_summary(df, str(tmp_path / "s.json"))
    text = "".join(p.read_text() for p in (tmp_path / "s.json").glob("part-*"))
    assert json.loads(text) == {"a": {"b": 1, "c": 2.5}} and path.endswith("s.json")
    path = sinks.export_summary(df, str(tmp_path / "s.csv"), "csv")
    assert spark.read.option("header", True).csv(path).columns == ["a_b", "a_c"]
    with pytest.raises(ValueError):
        sinks.export_summary(df, str(tmp_path / "s.xml"), "xml")


def test_quality(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0), (None, nan), (2, None), (None, 2.0)], "a int, b double")
    rows = {r["column_name"]: r for r in quality.quality_report(df).collect()}
    assert (rows["a"]["total_rows"], rows["a"]["duplicate_rows"], rows["a"]["null_count"]) == (6, 2, 2)
    assert rows["b"]["null_count"] == 2 and rows["b"]["data_type"] == "double"


def test_duplicates_see_where_nulls_are(spark):
    df = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert quality.quality_report(df).first()["duplicate_rows"] == 0


def test_integrity_lists_only_findings(spark):
    items = spark.createDataFrame([(1, 5.0)], "id int, price double")
    orders = spark.createDataFrame([(1, 0.0), (2, 3.0)], "id int, total double")
    rows = quality.integrity_check(items, orders, [("lines", orders, "id", items, "id")]).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("fct_orders", "orders with zero total", 1),
        ("lines", "rows whose id has no match", 1),
    ]
