"""Seasonality of one shop's customer orders (SEa-SEk).

Everything by day follows from one frame with a row for each day that has
orders, aggregated from the orders in one pass; its size is bounded by the
calendar, not by the data, so the windows over all of its rows are small.
A double date is told by its day and month alone, and range predicates ("date
within [h-14, h-1]") become equi-joins by exploding each window into its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.calendar import weekday0, year_month
from orderlens.operators.intervals import interval_join, with_inside
from orderlens.operators.model import ORDER_KEY, Model, date_spine


def _of_shop(m: Model, rows: DataFrame) -> DataFrame:
    shop = m.params.seasonality_shop
    return rows if shop is None else rows.where(F.col("shop") == shop)


def _shop_orders(m: Model) -> DataFrame:
    return _of_shop(m, m.orders)


def _shop_fact(m: Model) -> DataFrame:
    return _of_shop(m, m.fact_customer)


def _is_double(date: Column) -> Column:
    """Day and month are the same number; false for a null date."""
    return F.coalesce(F.dayofmonth(date) == F.month(date), F.lit(False))


def _daily(m: Model) -> DataFrame:
    """Per order date of the shop: orders, and sums over the completed ones."""
    done = F.col("is_completed")

    def over_done(c: str) -> Column:
        return F.sum(F.when(done, F.col(c))).alias(f"done_{c}")

    return _shop_orders(m).groupBy(F.col("order_date").alias("date")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(done).alias("n_done"),
        over_done("total_paid_price"), over_done("total_seller_discount"), over_done("total_platform_discount"),
    )


def _daily_dense(orders: DataFrame) -> DataFrame:
    """Orders per calendar day between the first and the last one: each day
    with orders also gives the days up to the next, with 0 orders."""
    until = F.coalesce(F.date_sub(F.lead("date").over(Window.orderBy("date")), 1), F.col("date"))
    days = orders.where(F.col("order_date").isNotNull()).groupBy(F.col("order_date").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    days = days.select("n_orders", F.col("date").alias("first"), until.alias("until"))
    spans = days.select("n_orders", "first", F.explode(F.sequence("first", "until")).alias("date"))
    return spans.select("date", F.when(F.col("date") == F.col("first"), F.col("n_orders")).otherwise(F.lit(0)).alias("n_orders"))


def _holidays(m: Model) -> DataFrame:
    return m.spark.createDataFrame([(h,) for h in m.params.holidays], "holiday date")


def orders_calendar(m: Model) -> DataFrame:
    """SEa: the shop's orders with month, weekday (0 = Sunday), weekday name and hour."""
    return _shop_orders(m).select(
        "order_number", "order_date", "created_at",
        year_month(F.col("order_date")).alias("year_month"),
        weekday0(F.col("order_date")).alias("weekday_num"),
        F.date_format("created_at", "EEEE").alias("weekday_name"),
        F.hour("created_at").alias("hour"),
        "pay_method", "is_completed", "total_paid_price", "total_unit_price",
        "total_seller_discount", "total_platform_discount", "n_items",
    )


def monthly_net_revenue(m: Model) -> DataFrame:
    """SEb: completed orders' revenue net of seller discount, per month."""
    return (
        _shop_orders(m).where(F.col("is_completed"))
        .groupBy(year_month(F.col("order_date")).alias("year_month"))
        .agg(
            F.sum(F.col("total_unit_price") - F.col("total_seller_discount")).alias("revenue"),
            F.count(F.lit(1)).alias("n_orders"),
        )
    )


def double_dates(m: Model) -> DataFrame:
    """SEc: days d/m with d = m (9/9 and 11/11 included) inside the shop's range."""
    bounds = _shop_orders(m).agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    return date_spine(bounds).where(_is_double(F.col("date")))


def campaign_rate_baseline(m: Model) -> DataFrame:
    """SEd: share of the shop's customer lines that carry a campaign flag."""
    return _shop_fact(m).agg(
        F.avg(F.col("campaign_flag").isNotNull().cast("int")).alias("campaign_rate"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def campaign_rate_on_double_dates(m: Model) -> DataFrame:
    """SEe: per double date: orders, lines and campaign-flag rate.

    One pass over the lines: partial sums per (order, day), from which a window
    over the order's few days tells its size (bulk or not) and its date; then
    everything is summed per day. Lines without an order key count for no day.
    """
    p = m.params
    order = Window.partitionBy(*ORDER_KEY)
    lines = _of_shop(m, m.fact)
    parts = lines.groupBy(*ORDER_KEY, "order_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("campaign_flag").isNotNull()).alias("flagged"))
    parts = parts.select(
        "*", F.sum("n").over(order).alias("order_size"), F.min("order_date").over(order).alias("first_date"))
    keyed = F.col("order_number").isNotNull()
    days = parts.where(F.col("order_size") < p.bulk_threshold).groupBy("order_date").agg(
        F.sum(F.when(keyed, F.col("n"))).alias("n_lines"),
        F.sum(F.when(keyed, F.col("flagged"))).alias("n_flagged"),
        F.count_if(F.col("order_date") == F.col("first_date")).alias("n_orders"),
    )
    with_orders = F.when(F.col("n_orders") > 0, F.col("order_date"))
    whole = Window.partitionBy()
    days = days.select("*", F.min(with_orders).over(whole).alias("lo"), F.max(with_orders).over(whole).alias("hi"))
    return days.where(
        _is_double(F.col("order_date")) & F.col("order_date").between(F.col("lo"), F.col("hi")) & (F.col("n_lines") > 0)
    ).select(
        "order_date", F.when(F.col("n_orders") > 0, F.col("n_orders")).alias("n_orders"), "n_lines",
        (F.col("n_flagged") / F.col("n_lines")).alias("campaign_rate"),
    )


def campaign_day_summary(m: Model) -> DataFrame:
    """SEf: campaign days vs other days; per-day means use the days that had
    orders; AOV and mean discount over completed orders."""
    n, done = F.sum("n_orders"), F.sum("n_done")
    agg = _daily(m).groupBy(_is_double(F.col("date")).alias("is_campaign_day")).agg(
        F.count("date").alias("days_with_orders"),
        n.alias("n_orders"),
        (F.lit(100.0) * (F.lit(1) - done / n)).alias("cancel_pct"),
        F.try_divide(F.sum("done_total_paid_price"), done).alias("aov_completed"),
        F.try_divide(F.sum("done_total_seller_discount") + F.sum("done_total_platform_discount"), done).alias(
            "mean_discount_completed"),
    )
    return agg.withColumn("orders_per_day", F.try_divide(F.col("n_orders"), F.col("days_with_orders")))


def campaign_weekday_mix(m: Model) -> DataFrame:
    """SEg: weekdays of the campaign days that had orders."""
    return _daily(m).where(_is_double(F.col("date"))).groupBy(
        F.date_format("date", "EEEE").alias("weekday_name"), weekday0(F.col("date")).alias("weekday_num")
    ).agg(F.count(F.lit(1)).alias("n_days"))


def pre_holiday_summary(m: Model) -> DataFrame:
    """SEh: the days [h - n, h - 1] before each holiday vs a clean baseline
    (neither campaign day nor pre-holiday day); per day = orders / days with orders."""
    p = m.params
    windows = _holidays(m).select(F.date_sub("holiday", p.pre_holiday_days).alias("low"), F.date_sub("holiday", 1).alias("high"))
    days = with_inside(_daily(m), "date", windows, "low", "high", "_pre")
    pre = F.col("_pre")
    base = ~pre & ~_is_double(F.col("date"))
    has_date = F.col("date").isNotNull()

    def orders_of(kind: Column) -> Column:
        return F.coalesce(F.sum(F.when(kind, F.col("n_orders"))), F.lit(0))

    one = days.agg(
        F.count_if(pre & has_date).alias("d_pre"),
        orders_of(pre).alias("n_pre"),
        F.count_if(base & has_date).alias("d_base"),
        orders_of(base).alias("n_base"),
    )
    rows = F.array(
        F.struct(F.lit("pre_holiday").alias("period"), F.col("d_pre").alias("days_with_orders"), F.col("n_pre").alias("n_orders")),
        F.struct(F.lit("baseline").alias("period"), F.col("d_base").alias("days_with_orders"), F.col("n_base").alias("n_orders")),
    )
    return one.select(F.explode(rows).alias("r")).select(
        "r.period", "r.days_with_orders", "r.n_orders",
        F.try_divide(F.col("r.n_orders"), F.col("r.days_with_orders")).alias("orders_per_day"),
    )


def daily_orders_dense(m: Model) -> DataFrame:
    """SEi: orders per calendar day, days without orders as 0."""
    return _daily_dense(_shop_orders(m))


def holiday_window_daily(m: Model) -> DataFrame:
    """SEj: daily orders from h - before to h + after around each holiday
    (days outside the data range are absent)."""
    p = m.params
    windows = _holidays(m).select(
        "holiday", F.date_sub("holiday", p.holiday_window_before).alias("low"), F.date_add("holiday", p.holiday_window_after).alias("high"))
    met = interval_join(_daily_dense(_shop_orders(m)), "date", windows, "low", "high")
    return met.select("holiday", "date", F.datediff("date", "holiday").alias("offset"), "n_orders")


def campaign_offset_profile(m: Model) -> DataFrame:
    """SEk: mean orders per day by offset -span..+span from each double date;
    days outside the data range are dropped, days inside without orders count
    as 0 (the denominator is calendar days)."""
    span = m.params.campaign_offset_span
    whole = Window.partitionBy()
    days = _daily_dense(_shop_orders(m)).select("*", F.min("date").over(whole).alias("lo"), F.max("date").over(whole).alias("hi"))
    around = days.select(
        "n_orders", "date", "lo", "hi", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset"),
    ).withColumn("campaign_day", F.date_sub("date", F.col("offset")))
    return (
        around.where(_is_double(F.col("campaign_day")) & F.col("campaign_day").between(F.col("lo"), F.col("hi")))
        .groupBy("offset")
        .agg(F.avg("n_orders").alias("mean_orders"), F.count(F.lit(1)).alias("calendar_days"))
    )
