"""Menu engineering: item performance, the popularity/price matrix and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larder.functions import labels as L
from larder.functions.ranks import exact_percentiles, percent_ranks
from larder.functions.scalars import attach, finite, lookup


def _per_item(rows: DataFrame) -> DataFrame:
    keyed = rows.where(F.col("item_id").isNotNull() & F.col("item_name").isNotNull())
    return keyed.groupBy("item_id", "item_name").agg(
        F.sum("order_count").alias("order_count"),
        F.avg("price").alias("price"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
    )


def item_performance(most_ordered: DataFrame, dim_items: DataFrame) -> DataFrame:
    """Orders, mean price and revenue per item over all places; items without a positive price are left out."""
    prices = dim_items.select(F.col("id").alias("item_id"), finite("price").alias("price"))
    sold = most_ordered.where(F.col("order_count") > 0).select("item_id", "item_name", "order_count")
    priced = sold.join(prices.where(F.col("price") > 0), "item_id")
    return _per_item(priced.withColumn("revenue", F.col("price") * F.col("order_count")))


def live_item_performance(order_items: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Quantity and revenue per item of the live orders, with the item's details where it has any."""
    sold = (
        order_items.where(F.col("menu_item_id").isNotNull())
        .groupBy(F.col("menu_item_id").alias("item_id"))
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("order_count"),
            F.coalesce(F.sum(F.col("quantity") * F.col("price_at_time")), F.lit(0.0)).alias("revenue"),
        )
    )
    details = menu_items.select(
        F.col("id").alias("item_id"),
        F.col("name").alias("item_name"),
        "price",
        "category",
        "description",
        "restaurant_id",
    )
    return sold.join(details, "item_id", "left")


def combined_item_performance(catalogue: DataFrame, live: DataFrame) -> DataFrame:
    """Catalogue and live performance as one, aggregated again where an item is in both."""
    columns = ["item_id", "item_name", "order_count", "price", "revenue"]
    return _per_item(catalogue.select(*columns).unionByName(live.select(*columns)))


def menu_thresholds(items: DataFrame, popularity: float = 50, price: float = 50) -> DataFrame:
    """One row: the popularity and the price threshold as percentiles."""
    return exact_percentiles(
        items, {"popularity": ("order_count", popularity / 100), "profitability": ("price", price / 100)}
    )


def category_of(orders: Column, price: Column, popularity: Column, profitability: Column) -> Column:
    """Matrix category; a missing number counts as below its threshold."""
    popular = F.coalesce(orders >= popularity, F.lit(False))
    profitable = F.coalesce(price >= profitability, F.lit(False))
    return (
        F.when(popular & profitable, L.STAR)
        .when(popular, L.PLOWHORSE)
        .when(profitable, L.PUZZLE)
        .otherwise(L.DOG)
    )


def menu_matrix(items: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Items with their category, by the given thresholds or the medians of the items themselves.

    The two thresholds are fetched when called and become constants of the plan.
    """
    edge = _edges(menu_thresholds(items) if thresholds is None else thresholds)
    return items.withColumn("category", category_of(finite("order_count"), finite("price"), *edge))


def _edges(thresholds: DataFrame) -> tuple[Column, Column]:
    row = thresholds.first()
    return F.lit(row["popularity"]).cast("double"), F.lit(row["profitability"]).cast("double")


def _categories(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in L.MENU_CATEGORIES])).alias("category"))


def menu_category_metrics(classified: DataFrame) -> DataFrame:
    """Items, orders, revenue and shares per category; all four categories are listed."""
    per = classified.groupBy("category").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("order_count").alias("total_orders"),
        F.sum("revenue").alias("total_revenue"),
    )
    full = _categories(classified.sparkSession).join(per, "category", "left").fillna(0)
    everything = Window.partitionBy(F.lit(0))  # four rows
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.sum(c).over(everything)), F.lit(0.0))
    return full.withColumns({"pct_items": share("item_count"), "pct_revenue": share("total_revenue")})


def category_top_items(classified: DataFrame, category: str, n: int = 10, by: str = "revenue") -> DataFrame:
    """The n largest items of a category; for dogs the n smallest."""
    name = category.lower()
    if name not in L.CATEGORY_BY_NAME:
        raise ValueError(f"no such category: {category}")
    order = F.col(by).asc() if name == "dog" else F.col(by).desc()
    return classified.where(F.col("category") == L.CATEGORY_BY_NAME[name]).orderBy(order, "item_id").limit(n)


def menu_recommendations(classified: DataFrame) -> DataFrame:
    """One row per item: what to do, how urgent, and with what effect; urgent ones first."""
    return classified.select(
        "item_id",
        "item_name",
        "category",
        lookup("category", L.CATEGORY_ACTION).alias("action"),
        lookup("category", L.CATEGORY_PRIORITY).alias("priority"),
        lookup("category", L.CATEGORY_IMPACT).alias("expected_impact"),
    ).orderBy("priority", "item_id")


def pricing_suggestions(classified: DataFrame, increase: float = 0.12) -> DataFrame:
    """Price rise for plowhorses and what it would bring at unchanged orders; largest gain first."""
    return (
        classified.where(F.col("category") == L.PLOWHORSE)
        .withColumn("suggested_price", F.bround(F.col("price") * (1 + increase), 2))
        .withColumn("potential_revenue", F.col("suggested_price") * F.col("order_count"))
        .withColumn("revenue_gain", F.col("potential_revenue") - F.col("revenue"))
        .select(
            "item_id",
            "item_name",
            "order_count",
            "price",
            "suggested_price",
            "revenue",
            "potential_revenue",
            "revenue_gain",
        )
        .orderBy(F.desc("revenue_gain"), "item_id")
    )


def pricing_view(suggestions: DataFrame, limit: int | None = None) -> DataFrame:
    """Pricing suggestions as price changes with their rationale."""
    change = F.col("suggested_price") - F.col("price")
    view = suggestions.select(
        "item_id",
        "item_name",
        F.col("price").alias("current_price"),
        "suggested_price",
        change.alias("price_change"),
        F.try_divide(change * 100, F.col("price")).alias("price_change_pct"),
        F.lit(L.PRICING_RATIONALE).alias("rationale"),
        F.col("revenue_gain").alias("estimated_revenue_impact"),
    )
    return view if limit is None else view.orderBy(F.desc("estimated_revenue_impact"), "item_id").limit(limit)


def pricing_totals(view: DataFrame) -> DataFrame:
    """Total gain and mean price increase of the pricing view."""
    return view.agg(
        F.coalesce(F.sum("estimated_revenue_impact"), F.lit(0.0)).alias("total_gain"),
        F.avg("price_change_pct").alias("avg_increase_pct"),
    )


def pricing_opportunity(suggestions: DataFrame) -> DataFrame:
    return suggestions.agg(
        F.coalesce(F.sum("revenue_gain"), F.lit(0.0)).alias("total_revenue_gain"),
        F.count(F.lit(1)).alias("items_to_reprice"),
    )


def browse_items(
    classified: DataFrame,
    category: str | None = None,
    min_orders: int = 0,
    limit: int = 100,
    place_items: DataFrame | None = None,
    place_id: int | None = None,
    after: int | None = None,
) -> DataFrame:
    """A page of ``limit`` items by category and minimum orders; with ``place_items`` only what a place sells.

    ``after`` is the last item of the page before: the next page starts behind it, without counting rows again.
    """
    df = classified if after is None else classified.where(F.col("item_id") > after)
    if category:
        df = df.where(F.col("category") == L.CATEGORY_BY_NAME.get(category.lower(), category))
    if min_orders > 0:
        df = df.where(F.col("order_count") >= min_orders)
    if place_id is not None:
        df = df.join(place_items.where(F.col("place_id") == place_id).select("item_id"), "item_id", "left_semi")
    return df.orderBy("item_id", "item_name").limit(limit)


def recommendations_by_category(classified: DataFrame, category: str | None = None) -> DataFrame:
    """One row per category found: action, number of items, priority."""
    df = classified
    if category:
        df = df.where(F.lower("category").contains(category.lower()))
    return (
        df.groupBy("category")
        .agg(F.count(F.lit(1)).alias("items_affected"))
        .select(
            "category",
            lookup("category", L.CATEGORY_ACTION).alias("action"),
            "items_affected",
            lookup("category", L.CATEGORY_PRIORITY).alias("priority"),
            lookup("category", L.CATEGORY_IMPACT).alias("expected_impact"),
        )
        .orderBy("priority")
    )


def classify_new_items(predicted: DataFrame, thresholds: DataFrame, days: int = 730) -> DataFrame:
    """Category of items (item_id, price, daily_demand) by stored thresholds, demand scaled to their time span."""
    orders = F.coalesce(F.col("daily_demand"), F.lit(0.0)) * days
    return predicted.withColumn("estimated_orders", orders).withColumn(
        "category", category_of(F.col("estimated_orders"), F.col("price"), *_edges(thresholds))
    )


def menu_items_with_orders(menu_items: DataFrame, order_items: DataFrame) -> DataFrame:
    """Menu items with ordered quantity, revenue and number of orders, 0 where nothing was ordered."""
    stats = (
        order_items.where(F.col("menu_item_id").isNotNull())
        .groupBy("menu_item_id")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            F.sum("total_cost").alias("total_revenue"),
            F.countDistinct("order_id").alias("order_count"),
        )
    )
    return (
        menu_items.join(stats, menu_items["id"] == stats["menu_item_id"], "left")
        .drop("menu_item_id")
        .fillna(0, subset=["total_quantity", "total_revenue", "order_count"])
    )


def menu_summary(
    dim_items: DataFrame, orders: DataFrame, order_items: DataFrame, campaigns: DataFrame, classified: DataFrame
) -> DataFrame:
    """One row: sizes of the data and items per category."""
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return classified.agg(
        *[F.count_if(F.col("category") == L.CATEGORY_BY_NAME[c]).alias(f"{c}s") for c in L.CATEGORY_BY_NAME]
    ).select(
        rows(dim_items).alias("total_items"),
        orders.agg(F.countDistinct("place_id")).scalar().alias("total_restaurants"),
        rows(orders).alias("total_orders"),
        rows(order_items).alias("total_order_items"),
        rows(campaigns).alias("total_campaigns"),
        "stars",
        "plowhorses",
        "puzzles",
        "dogs",
    )


def price_stats(items: DataFrame, column: str = "price") -> DataFrame:
    """count, mean, std, min, quartiles and max of a price column."""
    quartiles = exact_percentiles(items, {"p25": (column, 0.25), "p50": (column, 0.5), "p75": (column, 0.75)})
    v = finite(column)
    rest = items.agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return attach(rest, q=quartiles).select("count", "mean", "std", "min", "q.p25", "q.p50", "q.p75", "max")


def price_histogram(items: DataFrame, column: str = "price", bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and the largest price; the largest belongs to the last bin.

    When all prices are equal the range is one unit wide around them. The range is fetched when called.
    """
    v = items.select(finite(column).alias("v")).where("v IS NOT NULL")
    span = v.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    low, high = span["low"] or 0.0, span["high"] or 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    slot = F.least(F.floor(F.lit(float(bins)) * (F.col("v") - low) / (high - low)), F.lit(bins - 1))
    counts = v.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("items"))
    every = items.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("items", F.lit(0)).alias("items"),
    )


def price_bands(items: DataFrame, column: str = "price") -> DataFrame:
    """Items per price band, bands closed on the right; a price of 0 or less is in none."""
    v = finite(column)
    band = F.when(v <= 0, None)
    for upper, name in zip(L.PRICE_BAND_EDGES[1:], L.PRICE_BAND_NAMES):
        band = band.when(v <= upper, name)
    band = band.when(v > L.PRICE_BAND_EDGES[-1], L.PRICE_BAND_NAMES[-1])
    return (
        items.select(band.alias("band")).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("items"))
    )


def category_share(classified: DataFrame) -> DataFrame:
    """Items per category found, with their percent."""
    per = classified.groupBy("category").agg(F.count(F.lit(1)).alias("items"))
    everything = Window.partitionBy(F.lit(0))  # at most four rows
    return per.withColumn("pct", F.col("items") * 100.0 / F.sum("items").over(everything))


def bubble_sizes(classified: DataFrame) -> DataFrame:
    """Items with a plot size that grows with their revenue."""
    top = classified.agg(F.max("revenue")).scalar()
    return classified.withColumn("bubble_size", F.try_divide("revenue", top) * 500 + 20)


def item_scores(classified: DataFrame) -> DataFrame:
    """Items with popularity and profitability as percent ranks from 0 to 100."""
    ranked = percent_ranks(classified, {"popularity_score": "order_count", "profitability_score": "price"})
    return ranked.withColumns({c: F.col(c) * 100 for c in ("popularity_score", "profitability_score")})
