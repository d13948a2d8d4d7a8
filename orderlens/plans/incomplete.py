"""Analysis 1: incomplete orders (A1a-A1f). Reads the customer views only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.calendar import day_diff, minute_diff, year_month
from orderlens.operators.model import ORDER_KEY, Model
from orderlens.operators.ranking import exact_quantiles
from orderlens.session import checkpoint_once


def incomplete_by_month(m: Model) -> DataFrame:
    """A1a: orders, completed, incomplete, % incomplete and lost list value per
    month.

    The reference joins the calendar dimension to get the month label. The
    calendar spans exactly the first..last order date of the same lines, so
    every order matches one calendar row; the label is computed from the
    order date directly and the join (plus the extra min/max pass that builds
    the calendar) is skipped.
    """
    bad = ~F.col("is_completed")
    return (
        m.orders.groupBy(year_month(F.col("order_date")).alias("year_month"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.count_if(F.col("is_completed")).alias("n_completed"),
            F.count_if(bad).alias("n_incomplete"),
            F.sum(F.when(bad, F.col("total_unit_price"))).alias("lost_revenue"),
        )
        .withColumn("pct_incomplete", F.lit(100.0) * F.col("n_incomplete") / F.col("n_orders"))
    )


def _order_reasons(m: Model, *extra) -> DataFrame:
    """(order, reason) of incomplete lines, all orders; the inner join with the
    customer orders that follows leaves the bulk ones out."""
    bad = m.fact.where(~F.col("is_completed") & F.col("fail_reason").isNotNull())
    for condition in extra:
        bad = bad.where(condition)
    return bad.select(*ORDER_KEY, "fail_reason").distinct()


def incomplete_by_reason(m: Model) -> DataFrame:
    """A1b: at order level, an order with two reasons counts under both, with
    its whole list value each time. The share uses a window over the handful
    of aggregated reason rows."""
    r = _order_reasons(m).join(m.orders.select(*ORDER_KEY, "total_unit_price"), ORDER_KEY, "inner")
    agg = r.groupBy("fail_reason").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("total_unit_price").alias("lost_revenue"),
    )
    return agg.withColumn("pct", F.lit(100.0) * F.col("n_orders") / F.sum("n_orders").over(Window.partitionBy()))


def delivery_days_by_carrier(m: Model) -> DataFrame:
    """A1c: completed lines with a delivery time: lines, mean and median days.
    The lines collapse to a count for each carrier and number of days."""
    days = day_diff(F.col("created_at"), F.col("delivered_at"))
    lines = m.fact_customer.where(F.col("is_completed") & F.col("delivered_at").isNotNull())
    counts = checkpoint_once(lines.groupBy("carrier", days.alias("days")).agg(F.count(F.lit(1)).alias("n")))
    agg = counts.groupBy("carrier").agg(
        F.sum("n").alias("n_lines"),
        F.try_divide(F.sum(F.col("days") * F.col("n")), F.sum(F.when(F.col("days").isNotNull(), F.col("n")))).alias("mean_days"),
    )
    med = exact_quantiles(counts, "days", [0.5], ["carrier"], weight="n").withColumnRenamed("carrier", "_carrier")
    return agg.join(med, F.col("carrier").eqNullSafe(F.col("_carrier")), "left").select(
        "carrier", "n_lines", "mean_days", F.col("`q_0.5`").alias("median_days"))


def wait_before_cancel(m: Model) -> DataFrame:
    """A1d: days from creation to cancellation for one failure reason."""
    p = m.params
    return (
        m.fact_customer.where(~F.col("is_completed") & (F.col("fail_reason") == p.reason_slow))
        .groupBy("carrier")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.avg(day_diff(F.col("created_at"), F.col("updated_at"))).alias("mean_days"),
        )
    )


def duplicate_cancel_speed(m: Model) -> DataFrame:
    """A1e: minutes from creation to cancellation of duplicate orders, in hours,
    plus three speed bands. The lines collapse to a count for each number of
    minutes, and the median is the distributed quantile over those."""
    p = m.params
    mins = minute_diff(F.col("created_at"), F.col("updated_at"))
    lines = m.fact_customer.where(~F.col("is_completed") & (F.col("fail_reason") == p.reason_duplicate))
    counts = checkpoint_once(lines.groupBy(mins.alias("mins")).agg(F.count(F.lit(1)).alias("n")))
    median = exact_quantiles(counts, "mins", [0.5], weight="n").select(F.col("`q_0.5`") / F.lit(60.0)).scalar()
    x, n = F.col("mins"), F.col("n")

    def lines_with(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return counts.agg(
        lines_with(F.lit(True)).alias("n_lines"),
        (F.try_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n))) / F.lit(60.0)).alias("mean_hours"),
        lines_with(x <= 60).alias("n_within_1h"),
        lines_with(x.between(61, 1440)).alias("n_1h_to_1d"),
        lines_with(x > 1440).alias("n_over_1d"),
    ).select("n_lines", "mean_hours", median.alias("median_hours"), "n_within_1h", "n_1h_to_1d", "n_over_1d")


def unpaid_by_pay_method(m: Model) -> DataFrame:
    """A1f: orders failed for the 'unpaid' reason by pay method (null is a group)."""
    keys = _order_reasons(m, F.col("fail_reason") == m.params.reason_unpaid).drop("fail_reason")
    return (
        keys.join(m.orders.select(*ORDER_KEY, "pay_method", "total_unit_price"), ORDER_KEY, "inner")
        .groupBy("pay_method")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("total_unit_price").alias("lost_revenue"))
    )
