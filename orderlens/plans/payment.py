"""Analysis 3: cash on delivery vs prepaid (A3a-A3c), at order level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.model import Model


def cod_vs_prepaid(m: Model) -> DataFrame:
    """A3a + A3b: orders with a known pay method; revenue per order is list
    price minus seller discount.

    The reference re-joins every order to its lines to sum that revenue; the
    order dimension already holds both sums (over the same lines), so the
    join - a second pass over the fact and a shuffle - is not needed.
    """
    p = m.params
    done = F.col("is_completed")
    revenue = F.col("total_unit_price") - F.col("total_seller_discount")
    return (
        m.orders.where(F.col("pay_method").isNotNull())
        .groupBy(F.when(F.col("pay_method") == p.cod_value, "COD").otherwise("prepaid").alias("pay_group"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            (F.lit(100.0) * (F.lit(1) - F.avg(done.cast("int")))).alias("cancel_pct"),
            F.avg(F.when(done, revenue)).alias("revenue_per_completed"),
            (F.sum(F.when(done, revenue).otherwise(F.lit(0))) / F.count(F.lit(1))).alias("revenue_per_initiated"),
        )
    )


def pay_group_share(m: Model) -> DataFrame:
    """A3c: share of orders by pay group, the undetermined group included."""
    p = m.params
    pm = F.col("pay_method")
    group = F.when(pm == p.cod_value, "COD").when(pm.isNull(), "undetermined").otherwise("prepaid")
    agg = m.orders.groupBy(group.alias("pay_group")).agg(F.count(F.lit(1)).alias("n_orders"))
    return agg.withColumn("pct", F.lit(100.0) * F.col("n_orders") / F.sum("n_orders").over(Window.partitionBy()))
