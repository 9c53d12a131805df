"""The named tables as views over TPC-H-like test tables, so that every operator runs on the same data as its check."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _stock() -> Column:
    return ((F.col("p_partkey") * 37) % 1000).cast("double")


class Standins:
    """Lazy views over ``<sf_dir>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored_bytes(self) -> int:
        """Bytes of the files of the order tables; their content is not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.sf_dir)
        own = files.where(F.col("path").rlike(r"/(customer|orders|lineitem|part|supplier|events)\.parquet"))
        return own.agg(F.sum("length")).first()[0] or 0

    @cached_property
    def orders(self) -> DataFrame:
        seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
        return (
            self.raw("orders")
            .join(customers, "o_custkey")
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("c_nationkey").alias("place_id"),
                (seconds + ((F.col("o_orderkey") % 97) % 24) * 3600).alias("created"),
                F.col("o_totalprice").alias("total_amount"),
                F.col("o_orderpriority").alias("type"),
                F.when(F.col("o_orderkey") % 3 == 0, "cash").otherwise("card").alias("payment_method"),
                F.col("c_mktsegment").alias("source"),
                F.col("o_orderstatus").alias("status"),
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_partkey").alias("menu_item_id"),
            F.col("l_quantity").alias("quantity"),
            price.alias("price"),
            F.when(F.col("l_linestatus") == "F", price * 0.6).alias("cost"),
            F.col("l_extendedprice").alias("total_cost"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("commission_amount"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"),
            F.col("p_retailprice").alias("price"),
            F.col("p_type").alias("type"),
            F.col("p_size").alias("section_id"),
            F.when(F.col("p_size") % 5 == 0, "Inactive").otherwise("Active").alias("status"),
            F.lit(25.0).alias("vat"),
        )

    @cached_property
    def most_ordered(self) -> DataFrame:
        lines = self.order_items.select("order_id", "item_id").join(
            self.orders.select(F.col("id").alias("order_id"), "place_id"), "order_id"
        )
        counts = lines.groupBy("place_id", "item_id").agg(F.countDistinct("order_id").alias("order_count"))
        return counts.join(self.items.select(F.col("id").alias("item_id"), F.col("title").alias("item_name")), "item_id")

    @cached_property
    def menu_items(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
        key = F.col("p_partkey")
        return (
            self.raw("part")
            .join(lines, "p_partkey", "left")
            .select(
                key.alias("id"),
                key.alias("index"),
                F.col("p_retailprice").alias("price"),
                (F.lit(3.0) + (key % 21) / F.lit(10.0)).alias("rating"),
                (key % 100).alias("votes"),
                F.coalesce("n", F.lit(0)).alias("purchases"),
            )
        )

    @cached_property
    def places(self) -> DataFrame:
        regions = self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return (
            self.raw("nation")
            .join(regions, "n_regionkey")
            .select(
                F.col("n_nationkey").alias("id"),
                F.col("n_name").alias("title"),
                F.col("r_name").alias("country"),
                F.col("r_name").alias("area"),
                F.when(F.col("n_nationkey") % 4 == 0, 0).otherwise(1).alias("active"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        spent = (
            self.raw("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
        )
        nations = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return (
            self.raw("customer")
            .join(spent, "c_custkey", "left")
            .join(nations, "c_nationkey")
            .select(
                F.col("c_custkey").alias("id"),
                F.coalesce("n", F.lit(0)).alias("orders"),
                F.coalesce("spent", F.lit(0.0)).alias("cltv"),
                F.col("c_mktsegment").alias("source"),
                F.col("n_name").alias("country"),
            )
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        discount = (
            self.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_discount").alias("d"))
        )
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return (
            self.raw("supplier")
            .join(discount, "s_suppkey")
            .join(nations, "s_nationkey")
            .select(
                F.col("s_suppkey").alias("id"),
                F.col("s_name").alias("title"),
                (F.col("d") * 100).alias("discount"),
                F.col("n_name").alias("type"),
                F.when(F.col("s_acctbal") > 0, "Active").otherwise("Expired").alias("status"),
            )
        )

    @cached_property
    def add_ons(self) -> DataFrame:
        return (
            self.raw("part")
            .where("p_size <= 10")
            .select(
                F.col("p_partkey").alias("id"),
                F.col("p_name").alias("title"),
                F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_retailprice")).alias("price"),
                F.when(F.col("p_size") % 5 == 0, "Inactive").otherwise("Active").alias("status"),
            )
        )

    @cached_property
    def invoices(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("description")
        )

    @cached_property
    def cash(self) -> DataFrame:
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return (
            self.raw("orders")
            .join(customers, "o_custkey")
            .groupBy("c_nationkey", F.to_date("o_orderdate").alias("day"))
            .agg(F.min("o_totalprice").alias("opening_balance"), F.max("o_totalprice").alias("closing_balance"))
        )

    @cached_property
    def taxonomy(self) -> DataFrame:
        return self.raw("part").select(F.col("p_brand").alias("vocabulary"))

    @cached_property
    def bill_of_materials(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("parent_sku_id"),
            F.explode(F.array(F.col("p_size").cast("bigint"), 100 + key % 25)).alias("sku_id"),
            (1 + key % 3).alias("quantity"),
        )

    @cached_property
    def current_inventory(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("item_id"), _stock().alias("current_stock"))

    @cached_property
    def inventory_reports(self) -> DataFrame:
        reorder = (F.lit(20) + F.col("p_size")).cast("double")
        copies = F.array(
            *[F.struct(F.lit(n).alias("copy"), F.lit(f).alias("factor")) for n, f in ((1, 1.0), (2, 0.5), (3, 0.1))]
        )
        return (
            self.raw("part")
            .select("p_partkey", "p_size", F.inline(copies))
            .select(
                (F.col("p_partkey") * 10 + F.col("copy")).alias("id"),
                F.timestamp_seconds(F.lit(1704067200) + F.col("copy") * 86400).alias("date"),
                F.col("p_partkey").alias("item_id"),
                (_stock() * F.col("factor")).alias("current_stock"),
                reorder.alias("reorder_point"),
                (reorder * 0.5).alias("safety_stock"),
            )
        )

    @cached_property
    def skus(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            F.when(key % 50 == 0, "n/a").otherwise(key.cast("string")).alias("item_id"),
            _stock().alias("quantity"),
            (F.lit(20) + F.col("p_size")).cast("double").alias("low_stock_threshold"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def order_messages(self) -> DataFrame:
        """Purchases as order messages with one or two items."""
        event = F.col("event_id")
        item = lambda n, q, share: F.struct(
            ((event * 7 + n) % 200).alias("menu_item_id"),
            (1 + event % q).cast("bigint").alias("quantity"),
            (F.col("value") * share).alias("price"),
        )
        items = F.when(event % 2 == 0, F.array(item(1, 3, 0.5), item(2, 2, 0.25))).otherwise(F.array(item(1, 3, 1.0)))
        return self.events.where("event_type = 'purchase'").select(
            event.cast("string").alias("order_id"),
            (F.col("user_id") % 25).alias("restaurant_id"),
            F.col("value").alias("total_amount"),
            items.alias("items"),
            F.col("ts").alias("sent"),
        )

    @cached_property
    def live_menu_items(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"),
            (key % 25).alias("restaurant_id"),
            F.concat_ws(" ", "p_name", key.cast("string")).alias("name"),
            F.col("p_retailprice").alias("price"),
            F.col("p_type").alias("category"),
            F.lit(None).cast("string").alias("description"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def calls(self) -> DataFrame:
        """A call log from assistant turns: text lengths stand in for token counts."""
        return self.turns.where("role = 'assistant'").select(
            "conv_id",
            ((F.col("turn") + 1) * 50).alias("prompt_tokens"),
            F.floor(F.length("text") / 4).alias("completion_tokens"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        word = F.element_at(
            F.array(*[F.lit(w) for w in (" BEST items?", " remove what?", " Grow revenue", "")]),
            (F.col("conv_id") % 4 + 1).cast("int"),
        )
        return self.turns.where("role = 'user'").select("conv_id", "turn", F.concat("text", word).alias("text"))
