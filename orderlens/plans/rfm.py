"""Product RFM (RF1-RF5): recency, frequency and monetary value per product
over completed customer lines, quintile scores and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.config import RFM_SEGMENTS
from orderlens.operators.model import Model
from orderlens.operators.ranking import exact_quantiles, global_rank, quintile_from_rank
from orderlens.session import checkpoint_once


def _base(m: Model) -> DataFrame:
    k = m.params.product_key
    sales = m.fact_customer.where(F.col("is_completed"))
    # the null product is a group here only so that the snapshot (last
    # completed sale of *all* lines) comes out of the same pass; it is dropped
    # below, as a grouping that skips null keys would
    per = sales.groupBy(F.col(k).alias(k)).agg(
        F.max("order_date").alias("last_sale"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(F.col("unit_price") - F.col("seller_discount")).alias("monetary"),
    )
    # the per-product rows are written once to the checkpoint folder; the
    # snapshot is then a cheap scalar subquery over them instead of a second
    # pass over the fact
    per = checkpoint_once(per)
    snapshot = per.select(F.max("last_sale")).scalar()
    return per.where(F.col(k).isNotNull()).withColumn("recency_days", F.datediff(snapshot, F.col("last_sale")))


def rfm_base(m: Model) -> DataFrame:
    """RF1."""
    return _base(m)


def rfm_describe(m: Model) -> DataFrame:
    """RF2: count, mean, std, min, quartiles (linear interpolation), max of the
    three measures. The quartiles are exact and distributed (``ranking.
    exact_quantiles``: no column's values are gathered in one task); the
    sample standard deviation depends on summation order and is rounded.
    All parts are unioned in long form (stat, measure, value) and pivoted
    by measure - no join between one-row frames."""
    cols = ["recency_days", "frequency", "monetary"]
    stats = [
        ("count", lambda c: F.count(c).cast("double")),
        ("mean", lambda c: F.avg(c)),
        ("std", lambda c: F.round(F.stddev_samp(c), 6)),
        ("min", lambda c: F.min(c).cast("double")),
        ("max", lambda c: F.max(c).cast("double")),
    ]
    base = _base(m)
    one = base.agg(*[fn(F.col(c)).alias(f"{s}__{c}") for s, fn in stats for c in cols])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.lit(c).alias("measure"), F.col(f"`{s}__{c}`").alias("value"))
        for s, _ in stats for c in cols
    ])).alias("r")).select("r.*")
    labels = {0.25: "25%", 0.5: "50%", 0.75: "75%"}
    for c in cols:
        q = exact_quantiles(base, c, list(labels), prefix="q")
        long = long.unionByName(q.select(F.explode(F.array(*[
            F.struct(F.lit(lab).alias("stat"), F.lit(c).alias("measure"), F.col(f"`q_{p}`").alias("value"))
            for p, lab in labels.items()
        ])).alias("r")).select("r.*"))
    return long.groupBy("stat").pivot("measure", cols).agg(F.first("value"))


def rfm_scores(m: Model) -> DataFrame:
    """RF3 + RF4: quintile scores on first-come ranks (ties broken by the
    product key), recency reversed; total score and segment.

    Each rank is a distributed global sort (see ``ranking``); n comes with
    the first rank."""
    k = m.params.product_key
    r = global_rank(_base(m), [F.col("recency_days"), F.col(k)], "rank_r", total_col="n")
    n = F.col("n")
    r = global_rank(r, [F.col("frequency"), F.col(k)], "rank_f")
    r = global_rank(r, [F.col("monetary"), F.col(k)], "rank_m")
    scored = r.select(
        k, "last_sale", "frequency", "monetary", "recency_days",
        (F.lit(6) - quintile_from_rank(F.col("rank_r"), n)).alias("r_score"),
        quintile_from_rank(F.col("rank_f"), n).alias("f_score"),
        quintile_from_rank(F.col("rank_m"), n).alias("m_score"),
    ).withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
    seg = None
    for name, cut in RFM_SEGMENTS:
        cond = F.col("rfm_score") >= cut
        seg = F.when(cond, name) if seg is None else seg.when(cond, name)
    return scored.withColumn("segment", seg)


def rfm_segments(m: Model) -> DataFrame:
    """RF4: products per segment."""
    return rfm_scores(m).groupBy("segment").agg(F.count(F.lit(1)).alias("n_products"))


def rfm_segment_summary(m: Model) -> DataFrame:
    """RF5: products, revenue and revenue share per segment in the fixed
    order; a segment without products is kept with nulls."""
    agg = rfm_scores(m).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_products"), F.sum("monetary").alias("revenue"))
    order = m.spark.createDataFrame([(name, i + 1) for i, (name, _) in enumerate(RFM_SEGMENTS)],
                                    "segment string, segment_order int")
    # the share's denominator: a window over the (at most four) segment rows
    return order.join(agg, "segment", "left").withColumn(
        "revenue_pct", F.try_divide(F.lit(100.0) * F.col("revenue"), F.sum("revenue").over(Window.partitionBy())))
