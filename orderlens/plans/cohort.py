"""Product cohorts (CO1-CO4): first-sale month per product and the share of
each cohort still selling n months later.

The lines collapse to distinct (product, month) pairs first (a two-phase
aggregate), so every later step - first month per product, join back,
activity counts - works on pairs, never on the lines of a hot product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.model import Model


def _pairs(m: Model) -> DataFrame:
    k = m.params.product_key
    return (
        m.fact_customer.where(F.col(k).isNotNull())
        .select(F.col(k).alias("product"), F.trunc("order_date", "month").alias("month"))
        .distinct()
    )


def _activity(m: Model) -> DataFrame:
    pairs = _pairs(m)
    first = pairs.groupBy("product").agg(F.min("month").alias("cohort_month"))
    return pairs.join(first, "product", "inner").withColumn(
        "month_index", F.months_between("month", "cohort_month").cast("int")
    )


def _sizes(m: Model) -> DataFrame:
    first = _pairs(m).groupBy("product").agg(F.min("month").alias("cohort_month"))
    return first.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("n_products"))


def cohort_sizes(m: Model) -> DataFrame:
    """CO2: products per first-sale month."""
    return _sizes(m)


def cohort_activity(m: Model) -> DataFrame:
    """CO1 + CO3: distinct active products per cohort and month index, for
    cohorts of at least ``min_cohort_size`` products."""
    big = _sizes(m).where(F.col("n_products") >= m.params.min_cohort_size).select("cohort_month")
    return (
        _activity(m).join(big, "cohort_month", "left_semi")
        .groupBy("cohort_month", "month_index")
        .agg(F.count(F.lit(1)).alias("n_active"))
    )


def cohort_retention(m: Model) -> DataFrame:
    """CO4: active products as a percent of the cohort's month-0 actives, for
    the first ``retention_months`` month indices (long form: a month without
    activity is absent instead of shifting later columns)."""
    act = cohort_activity(m)
    base = act.where(F.col("month_index") == 0).select("cohort_month", F.col("n_active").alias("n_month0"))
    return (
        act.where(F.col("month_index") < m.params.retention_months)
        .join(base, "cohort_month", "inner")
        .select("cohort_month", "month_index", "n_active",
                (F.lit(100.0) * F.col("n_active") / F.col("n_month0")).alias("retention_pct"))
    )


def cohort_retention_matrix(m: Model) -> DataFrame:
    """CO4 as the table the notebook draws: one row per cohort, columns m0..m11
    = retention percent by month index. The pivot lists its values
    explicitly (no extra job to discover them); a month without activity is
    null in its own column rather than shifting later columns."""
    months = list(range(m.params.retention_months))
    ret = cohort_retention(m)
    wide = ret.groupBy("cohort_month").pivot("month_index", months).agg(F.first("retention_pct"))
    return wide.select("cohort_month", *[F.col(f"`{i}`").alias(f"m{i}") for i in months])
