"""Fixed schemas of the named tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: table and column names as the source files carry them -------------------------------------
_TABLES = {
    "dim_add_ons": "id long, title string, price double, status string",
    "dim_bill_of_materials": "id long, parent_sku_id long, sku_id long, quantity double",
    "dim_campaigns": "id long, title string, type string, status string, discount double",
    "dim_items": (
        "id long, title string, price double, description string, section_id long, status string, "
        "purchases long, vat double, type string"
    ),
    "dim_menu_item_add_ons": "id long, menu_item_id long, add_on_id long",
    "dim_menu_items": "id long, title string, price double, rating double, votes long, purchases long, index long",
    "dim_places": (
        "id long, title string, active int, country string, currency string, street_address string, "
        "area string, cuisine_ids string, rating double"
    ),
    "dim_skus": "id long, item_id string, title string, quantity double, low_stock_threshold double",
    "dim_stock_categories": "id long, title string",
    "dim_taxonomy_terms": "id long, vocabulary string, name string",
    "dim_users": "id long, orders long, cltv double, source string, country string",
    "fct_bonus_codes": "id long, code string",
    "fct_campaigns": "id long, title string, type string, status string, discount double",
    "fct_cash_balances": "id long, place_id long, opening_balance double, closing_balance double",
    "fct_inventory_reports": "id long, item_id long, quantity double",
    "fct_invoice_items": "id long, amount double, description string",
    "fct_order_items": (
        "id long, order_id long, item_id long, menu_item_id long, quantity double, price double, cost double, "
        "total_cost double, discount_amount double, commission_amount double"
    ),
    "fct_orders": (
        "id long, place_id long, created long, total_amount double, type string, payment_method string, "
        "source string, status string, total double"
    ),
    "most_ordered": "place_id long, item_id long, item_name string, order_count long",
}

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def struct(columns: str) -> T.StructType:
    """``"name type, name type"`` as a struct; needs no running session."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


CATALOG: dict[str, T.StructType] = {name: struct(columns) for name, columns in _TABLES.items()}

RESTAURANTS = struct("id long, name string, location string")
LIVE_MENU_ITEMS = struct("id long, restaurant_id long, name string, price double, category string, description string")
LIVE_ORDERS = struct("id string, restaurant_id long, timestamp timestamp, total_amount double")
LIVE_ORDER_ITEMS = struct("order_id string, line_no int, menu_item_id long, quantity long, price_at_time double")
INVENTORY_REPORT = struct(
    "date timestamp, item_id long, current_stock double, reorder_point double, safety_stock double"
)
ORDER_MESSAGE = struct("order_id string, restaurant_id long, total_amount double").add(
    "items", T.ArrayType(struct("menu_item_id long, quantity long, price double"))
)
