"""Dashboard metrics (DB1-DB8) over the customer views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.config import CANCELED_STATUS, RETURNED_STATUSES
from orderlens.operators.model import Model
from orderlens.operators.ranking import global_rank, global_running_sum



def _seller_net():
    return F.col("unit_price") - F.col("seller_discount")


def _costed(m: Model) -> DataFrame:
    """Completed lines' sums of products with a known cost, with their margin."""
    cost, _ = m.cost_lookup
    sums = m.line_sales.where(F.col("is_completed")).join(cost, "product_code")
    return sums.withColumn("margin", _seller_net() - F.col("n_lines") * F.col("cost"))


def biz_monthly(m: Model) -> DataFrame:
    """DB1: per month, completed orders' revenue (net of seller discount), AOV
    (paid incl. shipping), gross margin over lines with a known cost and the
    margin rate on those lines' revenue.

    Two grains, as the page shows them: revenue and AOV are of orders whose
    lines are all completed, margin and ``costed_revenue`` (the base of the
    rate) of completed lines of any order."""
    orders = m.order_sales.where(F.col("is_completed")).groupBy("year_month").agg(
        F.sum("n_orders").alias("n_orders"),
        F.sum(_seller_net()).alias("revenue"),
        (F.sum("paid_price") / F.sum("n_orders")).alias("aov"),
    )
    margin = _costed(m).groupBy("year_month").agg(
        F.sum("margin").alias("gross_margin"),
        F.sum(_seller_net()).alias("costed_revenue"),
    )
    return orders.join(margin, "year_month", "left").withColumn(
        "margin_rate_pct", F.try_divide(F.lit(100.0) * F.col("gross_margin"), F.col("costed_revenue")))


def _step(order: int, name: str, amount):
    return F.struct(F.lit(order).alias("step_order"), F.lit(name).alias("step"), amount.alias("amount"))


def revenue_bridge(m: Model) -> DataFrame:
    """DB2: completed lines: list value -> seller discount -> platform discount
    -> shipping -> paid, as signed steps in one aggregate."""
    one = m.line_sales.where(F.col("is_completed")).agg(
        F.sum("unit_price").alias("a1"), F.sum("seller_discount").alias("a2"),
        F.sum("platform_discount").alias("a3"), F.sum("shipping_fee").alias("a4"),
        F.sum("paid_price").alias("a5"),
    )
    steps = F.array(
        _step(1, "gross_list_value", F.col("a1")),
        _step(2, "seller_discount", -F.col("a2")),
        _step(3, "platform_discount", -F.col("a3")),
        _step(4, "shipping_fee", F.col("a4")),
        _step(5, "paid_received", F.col("a5")),
    )
    return one.select(F.explode(steps).alias("r")).select("r.*")


def pareto_revenue(m: Model) -> DataFrame:
    """DB3 + SK10: products by completed revenue (net of seller discount),
    rank, share and cumulative share; ties by product code. The running sum and
    the total come from one distributed pass (``ranking``)."""
    rev = (
        m.line_sales.where(F.col("is_completed"))
        .groupBy("product_code").agg(F.sum(_seller_net()).alias("revenue"))
    )
    run = global_running_sum(rev, [F.desc("revenue"), F.asc_nulls_first("product_code")],
                             {"cum_revenue": "revenue"}, rank_col="rank", totals={"total": "cum_revenue"})
    return run.select(
        "product_code", "revenue", "rank",
        F.try_divide(F.lit(100.0) * F.col("revenue"), F.col("total")).alias("pct"),
        F.try_divide(F.lit(100.0) * F.col("cum_revenue"), F.col("total")).alias("cum_pct"),
    )


def rank_revenue_vs_profit(m: Model) -> DataFrame:
    """DB4: rank by revenue and rank by gross margin, completed costed lines."""
    per = _costed(m).groupBy("product_code").agg(
        F.sum(_seller_net()).alias("revenue"), F.sum("margin").alias("profit"))
    r = global_rank(per, [F.desc("revenue"), F.asc_nulls_first("product_code")], "rank_revenue")
    return global_rank(r, [F.desc("profit"), F.asc_nulls_first("product_code")], "rank_profit")


def cancel_rate_by_product(m: Model) -> DataFrame:
    """DB5."""
    done = F.sum(F.when(F.col("is_completed"), F.col("n_lines")).otherwise(0))
    return m.line_sales.groupBy("product_code").agg(
        F.sum("n_lines").alias("n_lines"),
        (F.lit(100.0) * (F.lit(1) - done / F.sum("n_lines"))).alias("cancel_pct"),
    )


def status_mix_by_month(m: Model) -> DataFrame:
    """DB6: completed / canceled / returned / other lines per month and their
    share of the month (a window over the few aggregated rows of a month)."""
    st = F.col("status")
    group = (
        F.when(F.col("is_completed"), "completed")
        .when(st == CANCELED_STATUS, "canceled")
        .when(st.isin(*RETURNED_STATUSES), "returned")
        .otherwise("other")
    )
    agg = m.line_sales.groupBy("year_month", group.alias("status_group")).agg(F.sum("n_lines").alias("n_lines"))
    return agg.withColumn(
        "pct", F.lit(100.0) * F.col("n_lines") / F.sum("n_lines").over(Window.partitionBy("year_month")))


def cancel_rate_by_pay_method(m: Model) -> DataFrame:
    """DB8: order-level cancel rate per pay method (null is a group)."""
    done = F.sum(F.when(F.col("is_completed"), F.col("n_orders")).otherwise(0))
    return m.order_sales.groupBy("pay_method").agg(
        F.sum("n_orders").alias("n_orders"),
        (F.lit(100.0) * (F.lit(1) - done / F.sum("n_orders"))).alias("cancel_pct"),
    )
