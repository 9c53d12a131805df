"""Demand, its features, and the parts of the forecast that SQL can check."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larder.functions.calendar import order_calendar
from larder.operators import forecast
from larder.registry.base import query, r, rounded
from larder.session import written

AS_OF = dt.date(2001, 8, 1)


def lines(t):
    return forecast.order_lines(t.order_items, t.orders)


@query(
    "fc1_order_calendar",
    """SELECT id, placed AS order_datetime, order_date, hour, day_of_week, day_name, month, week_of_year, is_weekend
       FROM timed_orders""",
)
def fc1(t):
    return order_calendar(t.orders).select(
        "id",
        F.col("order_datetime").cast("timestamp_ntz").alias("order_datetime"),
        "order_date",
        "hour",
        "day_of_week",
        "day_name",
        "month",
        "week_of_year",
        "is_weekend",
    )


@query(
    "fc2_order_lines",
    "SELECT order_id, item_id, quantity, price, place_id, order_date, hour, day_of_week, is_weekend FROM order_lines",
)
def fc2(t):
    return lines(t).select(
        "order_id", "item_id", "quantity", "price", "place_id", "order_date", "hour", "day_of_week", "is_weekend"
    )


@query(
    "fc3_daily_demand",
    f"""SELECT place_id, item_id, date, quantity_demanded, {r('avg_price', 4)}, {r('avg_cost', 4)}, num_orders,
               day_of_week, month, week_of_year, is_weekend FROM daily_demand""",
)
def fc3(t):
    return rounded(forecast.daily_demand(lines(t)), avg_price=4, avg_cost=4)


@query(
    "fc3_hourly_demand",
    f"""SELECT place_id, item_id, date_trunc('hour', placed) AS date, sum(quantity) AS quantity_demanded,
               {r('avg(price)', 4, 'avg_price')}, count(DISTINCT order_id) AS num_orders
        FROM order_lines GROUP BY 1, 2, 3""",
)
def fc3_hourly(t):
    df = forecast.daily_demand(lines(t), "hourly").select(
        "place_id", "item_id", F.col("date").cast("timestamp_ntz").alias("date"), "quantity_demanded", "avg_price", "num_orders"
    )
    return rounded(df, avg_price=4)


@query(
    "fc3_weekly_demand",
    f"""SELECT place_id, item_id, CAST(date_trunc('week', order_date) AS DATE) AS date, sum(quantity) AS quantity_demanded,
               {r('avg(price)', 4, 'avg_price')}, count(DISTINCT order_id) AS num_orders
        FROM order_lines GROUP BY 1, 2, 3""",
)
def fc3_weekly(t):
    df = forecast.daily_demand(lines(t), "weekly").select(
        "place_id", "item_id", "date", "quantity_demanded", "avg_price", "num_orders"
    )
    return rounded(df, avg_price=4)


@query(
    "fc4_item_stats",
    f"""SELECT item_id, total_qty, {r('avg_daily_qty', 4)}, {r('std_daily_qty', 4)}, {r('avg_price', 4)}, total_orders
        FROM item_stats""",
)
def fc4(t):
    return rounded(forecast.item_stats(lines(t)), avg_daily_qty=4, std_daily_qty=4, avg_price=4)


@query("fc5_place_stats", f"SELECT place_id, total_orders, total_qty, {r('avg_order_value', 4)} FROM place_stats")
def fc5(t):
    return rounded(forecast.place_stats(lines(t)), avg_order_value=4)


@query(
    "fc6_enriched_demand",
    f"""SELECT place_id, item_id, date, quantity_demanded, {r('avg_daily_qty', 4)}, {r('std_daily_qty', 4)}, total_orders,
               total_orders_restaurant, {r('avg_order_value', 4)} FROM enriched""",
)
def fc6(t):
    df = forecast.demand_features(t.order_items, t.orders)
    return rounded(
        df.select(
            "place_id",
            "item_id",
            "date",
            "quantity_demanded",
            "avg_daily_qty",
            "std_daily_qty",
            "total_orders",
            "total_orders_restaurant",
            "avg_order_value",
        ),
        avg_daily_qty=4,
        std_daily_qty=4,
        avg_order_value=4,
    )


@query(
    "fc7_demand_lags",
    f"SELECT place_id, item_id, date, quantity_demanded, {r('lag_7d_avg', 4)}, {r('lag_14d_avg', 4)} FROM lagged",
)
def fc7(t):
    df = forecast.demand_features(t.order_items, t.orders).select(
        "place_id", "item_id", "date", "quantity_demanded", "lag_7d_avg", "lag_14d_avg"
    )
    return rounded(df, lag_7d_avg=4, lag_14d_avg=4)


# The cost of a day is unknown for about half of the rows; standing in for the price it puts gaps into the matrix.
@query(
    "fc8_feature_matrix",
    f"""SELECT place_id, item_id, date, day_of_week::DOUBLE AS day_of_week, month::DOUBLE AS month,
               week_of_year::DOUBLE AS week_of_year, is_weekend::DOUBLE AS is_weekend,
               {r('coalesce(avg_cost, (SELECT quantile_cont(avg_cost, 0.5) FROM lagged))', 4, 'avg_price')},
               {r('avg_daily_qty', 4)}, {r('std_daily_qty', 4)}, total_orders_restaurant::DOUBLE AS total_orders_restaurant,
               {r('avg_order_value', 4)}, {r('lag_7d_avg', 4)}, {r('lag_14d_avg', 4)}, quantity_demanded AS label
        FROM lagged""",
)
def fc8(t):
    demand = written(forecast.demand_features(t.order_items, t.orders), "demand").withColumn("avg_price", F.col("avg_cost"))
    return rounded(
        forecast.feature_matrix(demand),
        avg_price=4,
        avg_daily_qty=4,
        std_daily_qty=4,
        avg_order_value=4,
        lag_7d_avg=4,
        lag_14d_avg=4,
    )


@query(
    "fc10_forecaster_metrics",
    f"""SELECT {r('avg(abs(lag_7d_avg - quantity_demanded))', 4, 'mae')},
               {r('sqrt(avg((lag_7d_avg - quantity_demanded) * (lag_7d_avg - quantity_demanded)))', 4, 'rmse')},
               {r('1 - sum((lag_7d_avg - quantity_demanded) * (lag_7d_avg - quantity_demanded)) / (var_pop(quantity_demanded) * count(*))', 6, 'r2')},
               count(*) AS rows FROM lagged""",
)
def fc10(t):
    demand = forecast.demand_features(t.order_items, t.orders)
    return rounded(forecast.regression_metrics(demand, "quantity_demanded", "lag_7d_avg"), mae=4, rmse=4, r2=6)


@query(
    "fc12_request_features",
    f"""WITH d AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '2001-08-02', DATE '2001-08-09', INTERVAL 1 DAY)),
             pairs AS (SELECT DISTINCT item_id, place_id FROM daily_demand)
        SELECT item_id, place_id, date, {r('avg_price', 4)}, {r('avg_daily_qty', 4)}, {r('std_daily_qty', 4)},
               p.total_orders AS total_orders_restaurant, {r('avg_order_value', 4)},
               CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
               CAST(weekofyear(date) AS INTEGER) AS week_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               {r('avg_daily_qty', 4, 'lag_7d_avg')}, {r('avg_daily_qty', 4, 'lag_14d_avg')}
        FROM pairs JOIN item_stats i USING (item_id) JOIN place_stats p USING (place_id), d""",
)
def fc12(t):
    base = lines(t)
    items, places = forecast.item_stats(base), forecast.place_stats(base)
    df = forecast.request_features(forecast.forecast_requests(base, items, AS_OF), items, places)
    digits = ("avg_price", "avg_daily_qty", "std_daily_qty", "avg_order_value", "lag_7d_avg", "lag_14d_avg")
    return rounded(df, **{c: 4 for c in digits})


@query(
    "fc13_forecast_grid",
    """SELECT item_id, place_id, CAST(d.range AS DATE) AS date FROM (SELECT DISTINCT item_id, place_id FROM daily_demand),
              range(DATE '2001-08-02', DATE '2001-08-16', INTERVAL 1 DAY) d""",
)
def fc13(t):
    base = lines(t)
    return forecast.forecast_requests(base, forecast.item_stats(base), AS_OF, days=14)


@query(
    "fc13_forecast_grid_limited",
    """WITH i AS (SELECT item_id FROM item_stats ORDER BY total_qty DESC, item_id LIMIT 40),
            pairs AS (SELECT DISTINCT item_id, place_id FROM daily_demand WHERE item_id IN (SELECT item_id FROM i)),
            p AS (SELECT DISTINCT place_id FROM pairs ORDER BY place_id LIMIT 10)
       SELECT item_id, place_id, CAST(d.range AS DATE) AS date FROM pairs JOIN p USING (place_id),
              range(DATE '2001-08-02', DATE '2001-08-04', INTERVAL 1 DAY) d""",
)
def fc13_limited(t):
    base = lines(t)
    return forecast.forecast_requests(base, forecast.item_stats(base), AS_OF, days=2, top_items=40, max_places=10)


@query(
    "fc14_training_summary",
    """SELECT count(*) AS total_records, count(DISTINCT item_id) AS unique_items,
              count(DISTINCT place_id) AS unique_restaurants, min(date) AS first_date, max(date) AS last_date FROM daily_demand""",
)
def fc14(t):
    return forecast.training_summary(forecast.daily_demand(lines(t)))


@query(
    "fc15_forecast_band",
    f"""SELECT item_id, place_id, date, 'history' AS kind, {r('quantity_demanded', 4, 'demand')},
               CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM daily_demand
        UNION ALL
        SELECT item_id, place_id, CAST(date + INTERVAL 3000 DAY AS DATE), 'forecast', {r('lag_7d_avg', 4, 'demand')},
               {r('lag_7d_avg * 0.8::DOUBLE', 4, 'low')}, {r('lag_7d_avg * 1.2::DOUBLE', 4, 'high')} FROM lagged""",
)
def fc15(t):
    demand = forecast.demand_features(t.order_items, t.orders)
    ahead = demand.select(
        "item_id", "place_id", F.date_add("date", 3000).alias("date"), F.col("lag_7d_avg").alias("predicted_demand")
    )
    return rounded(forecast.forecast_band(demand, ahead), demand=4, low=4, high=4)
