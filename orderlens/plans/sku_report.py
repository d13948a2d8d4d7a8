"""SKU parsing results and checks (SK1-SK10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.sku import campaign_flag, has_gift, promo_label
from orderlens.operators.model import Model
from orderlens.operators.prefix_match import product_code_map


def _skus(m: Model) -> DataFrame:
    # distinct values first: the regexes run once per SKU, not once per line
    return m.items.select("seller_sku").distinct()


def sku_product_code(m: Model) -> DataFrame:
    """SK1: every distinct SKU with its longest-prefix base code (or null)."""
    return product_code_map(_skus(m), m.codes)


def sku_campaign_flag(m: Model) -> DataFrame:
    """SK2."""
    return _skus(m).withColumn("campaign_flag", campaign_flag(F.col("seller_sku")))


def sku_has_gift(m: Model) -> DataFrame:
    """SK3."""
    return _skus(m).withColumn("has_gift", has_gift(F.col("seller_sku")))


def sku_promo_label(m: Model) -> DataFrame:
    """SK4: label of every distinct item name."""
    return m.items.select("item_name").distinct().withColumn("promo_label", promo_label(F.col("item_name")))


def sku_coverage(m: Model) -> DataFrame:
    """SK5: percent of lines with each extracted attribute."""
    def pct(c):
        return F.lit(100.0) * F.avg(c.cast("int"))

    return m.parsed.agg(
        pct(F.col("product_code").isNotNull()).alias("pct_product_code"),
        pct(F.col("campaign_flag").isNotNull()).alias("pct_campaign_flag"),
        pct(F.col("has_gift")).alias("pct_has_gift"),
        pct(F.col("promo_label").isNotNull()).alias("pct_promo_label"),
    )


def sku_unmatched(m: Model) -> DataFrame:
    """SK6: distinct SKUs that match no base code."""
    return m.parsed.where(F.col("product_code").isNull()).select("seller_sku").distinct()


def sku_campaign_crosstab(m: Model) -> DataFrame:
    """SK7: product x campaign flag line counts (null flag is a group), top 20
    by lines; ties ordered by the keys so the top 20 is deterministic. The
    sort + limit plans as a TakeOrdered: each task keeps its own top 20."""
    return (
        m.parsed.groupBy("product_code", "campaign_flag")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), F.asc_nulls_first("product_code"), F.asc_nulls_first("campaign_flag"))
        .limit(20)
    )


def sku_reduction(m: Model) -> DataFrame:
    """SK9: distinct SKUs vs distinct base codes."""
    return m.parsed.agg(
        F.count_distinct("seller_sku").alias("n_skus"),
        F.count_distinct("product_code").alias("n_product_codes"),
    )
