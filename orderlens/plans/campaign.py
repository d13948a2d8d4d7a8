"""Analysis 2: campaign vs normal sales margin (A2a-A2f) and the two
statistical tests on the same sample (ST1-ST5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.config import ALPHA, EFFECT_SIZE_LABELS
from orderlens.functions.stats import EXACT_GROUP, EXACT_PAIRS, exact_u_tail, normal_two_sided_p, normal_upper_tail, significant
from orderlens.operators.model import Model
from orderlens.operators.ranking import exact_quantiles, global_running_sum
from orderlens.session import checkpoint_once

CAMPAIGN, NORMAL = "campaign", "normal"


def _item_margin(m: Model) -> DataFrame:
    """Customer lines with a known cost: cost, sale group and unit margin
    (list price - seller discount - cost).

    The reference joins ``dim_product`` (distinct codes left-joined to the
    cost table) and keeps rows with a cost; since the cost table has one row
    per code, that is exactly an inner join with the cost rows that have a
    cost, without the extra pass that lists the distinct codes. The cost
    table is broadcast behind a row-count check, so a product holding a third
    of the lines never becomes one hot join partition.
    """
    cost, _ = m.cost_lookup
    return (
        m.fact_customer.join(cost, "product_code", "inner")
        .withColumn("sale_group", F.when(F.col("campaign_flag").isNotNull(), CAMPAIGN).otherwise(NORMAL))
        .withColumn("margin", F.col("unit_price") - F.col("seller_discount") - F.col("cost"))
    )


def _eligible(im: DataFrame, min_n: int) -> DataFrame:
    """Codes with at least ``min_n`` lines in both groups (line-level input)."""
    g = F.col("sale_group")
    return (
        im.groupBy("product_code")
        .agg(F.count_if(g == CAMPAIGN).alias("n_campaign"), F.count_if(g == NORMAL).alias("n_normal"))
        .where((F.col("n_campaign") >= min_n) & (F.col("n_normal") >= min_n))
        .select("product_code")
    )


def _sample(m: Model) -> DataFrame:
    """Eligible lines with the margin realised per initiated line (0 if not
    completed) - the line-level sample the tests count pairs on. The queries
    below never materialise it: they work on collapsed rows."""
    im = _item_margin(m)
    return im.join(_eligible(im, m.params.min_sample), "product_code", "left_semi").withColumn(
        "margin_initiated", F.when(F.col("is_completed"), F.col("margin")).otherwise(F.lit(0))
    )


def _partial_sums(done: Column) -> list[Column]:
    depth = F.try_divide(F.col("seller_discount") + F.col("platform_discount"), F.col("unit_price"))
    realised = F.col("unit_price") - F.col("seller_discount") - F.col("platform_discount")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~done).alias("n_bad"),
        F.count_if(done).alias("n_done"),
        F.sum("seller_discount").alias("s_seller_discount"),
        F.sum("unit_price").alias("s_unit_price"),
        F.sum("cost").alias("s_cost"),
        F.sum(F.when(done, F.col("margin")).otherwise(F.lit(0))).alias("s_margin_initiated"),
        F.sum(F.when(done, realised)).alias("s_realised"),
        F.sum(depth).alias("s_depth"),
        F.count(depth).alias("n_depth"),
    ]


def _with_eligibility(rows: DataFrame, min_n: int) -> DataFrame:
    """Flag (product, group) aggregate rows whose product has at least
    ``min_n`` lines in both groups. The window spans one product's aggregated
    rows - at most two - never its lines."""
    w = Window.partitionBy("product_code")
    n_c = F.sum(F.when(F.col("sale_group") == CAMPAIGN, F.col("n")).otherwise(0)).over(w)
    n_n = F.sum(F.when(F.col("sale_group") == NORMAL, F.col("n")).otherwise(0)).over(w)
    return rows.withColumn("is_eligible", (n_c >= min_n) & (n_n >= min_n))


def _by_product_group(m: Model) -> DataFrame:
    """One pass over the customer lines with a cost: partial sums per
    (product, group), flagged with the product's eligibility."""
    done = F.col("is_completed")
    agg = _item_margin(m).groupBy("product_code", "sale_group").agg(*_partial_sums(done))
    return _with_eligibility(agg, m.params.min_sample)


def _by_value(m: Model, eligible: DataFrame) -> DataFrame:
    """Lines of the eligible products by (group, margin per initiated line).
    The eligible products are a subset of the cost table and broadcast if it
    is, so the lines go straight to these counts, whatever their product."""
    _, small = m.cost_lookup
    margin = F.when(F.col("is_completed"), F.col("margin")).otherwise(F.lit(0))
    lines = _item_margin(m).join(F.broadcast(eligible) if small else eligible, "product_code", "left_semi")
    return lines.groupBy("sale_group", margin.alias("margin_initiated")).agg(F.count(F.lit(1)).alias("n"))


def _cancel_pct() -> Column:
    return F.lit(100.0) * (F.lit(1) - F.sum("n_done") / F.sum("n"))


def _measures() -> list[Column]:
    return [
        F.sum("n").alias("n_lines"),
        _cancel_pct().alias("cancel_pct"),
        (F.sum("s_seller_discount") / F.sum("n")).alias("mean_seller_discount"),
        (F.sum("s_unit_price") / F.sum("n")).alias("mean_unit_price"),
        (F.sum("s_margin_initiated") / F.sum("n")).alias("margin_per_initiated"),
    ]


def item_margin(m: Model) -> DataFrame:
    """A2a."""
    return _item_margin(m).select(
        "order_number", "line_number", "shop", "product_code", "sale_group", "is_completed",
        "unit_price", "seller_discount", "platform_discount", "cost", "margin",
    )


def eligible_products(m: Model) -> DataFrame:
    """A2b: codes with at least ``min_sample`` lines in both groups."""
    return _by_product_group(m).where(F.col("is_eligible")).select("product_code").distinct()


def campaign_margin_by_product(m: Model) -> DataFrame:
    """A2c."""
    rows = _by_product_group(m).where(F.col("is_eligible"))
    return rows.groupBy("product_code", "sale_group").agg(*_measures())


def campaign_margin_one_product(m: Model) -> DataFrame:
    """A2d: one product (no eligibility rule), with its mean cost."""
    rows = _by_product_group(m).where(F.col("product_code") == m.params.hero_product)
    return rows.groupBy("sale_group").agg(*_measures(), (F.sum("s_cost") / F.sum("n")).alias("mean_cost"))


def campaign_margin_pooled(m: Model) -> DataFrame:
    """A2e: pooled over the eligible products, plus the total realised margin."""
    rows = _by_product_group(m).where(F.col("is_eligible"))
    return rows.groupBy("sale_group").agg(*_measures(), F.sum("s_margin_initiated").alias("total_margin"))


def campaign_summary(m: Model) -> DataFrame:
    """A2f + ST4: the notebook's line-level summary per group.

    The means are ratios of the integer sums per (product, group), which are
    written once (at most two rows a product) and also give the eligible
    products; the median is the distributed exact quantile over the counts per
    (group, margin) of their lines.
    Discount depth divides by the list price; a zero list price gives null
    (skipped by the mean) instead of infinity. The mean of ratios is a sum of
    non-integers whose last bits depend on summation order, so it is rounded
    to 9 decimals.
    """
    rows = checkpoint_once(_by_product_group(m).where(F.col("is_eligible")))
    agg = rows.groupBy("sale_group").agg(
        F.sum("n").alias("n_lines"),
        (F.lit(100.0) * (F.sum("n_bad") / F.sum("n"))).alias("cancel_pct"),
        F.try_divide(F.sum("s_realised"), F.sum("n_done")).alias("realised_price_completed"),
        F.round(F.lit(100.0) * F.try_divide(F.sum("s_depth"), F.sum("n_depth")), 9).alias("discount_depth_pct"),
        F.try_divide(F.sum("s_margin_initiated"), F.sum("n_done")).alias("mean_margin_completed"),
        (F.sum("s_margin_initiated") / F.sum("n")).alias("mean_margin_initiated"),
    )
    values = _by_value(m, rows.select("product_code").distinct())
    med = exact_quantiles(values, "margin_initiated", [0.5], ["sale_group"], weight="n").withColumnRenamed(
        "q_0.5", "median_margin_initiated")
    return agg.join(med, "sale_group", "left")


def _decision(p: Column) -> Column:
    return F.when(p <= ALPHA, "significant").otherwise("not_significant")


def ztest_cancel_rate(m: Model) -> DataFrame:
    """ST1 + ST5: two-proportion z-test of the cancel rate, pooled variance,
    two-sided; counts come from one aggregate."""
    g = F.col("sale_group")

    def total(c, grp):
        return F.coalesce(F.sum(F.when(g == grp, F.col(c))), F.lit(0)).cast("bigint")

    c = _by_product_group(m).where(F.col("is_eligible")).agg(
        total("n_bad", CAMPAIGN).alias("x1"), total("n", CAMPAIGN).alias("n1"),
        total("n_bad", NORMAL).alias("x2"), total("n", NORMAL).alias("n2"),
    )
    x1, n1, x2, n2 = (F.col(k) for k in ("x1", "n1", "x2", "n2"))
    # an empty group gives nulls (try_divide), not an error
    p1, p2 = F.try_divide(x1, n1), F.try_divide(x2, n2)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    var = pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    z = F.try_divide(p1 - p2, F.sqrt(var))
    out = c.select(
        "x1", "n1", "x2", "n2",
        p1.alias("cancel_rate_campaign"),
        p2.alias("cancel_rate_normal"),
        (p1 - p2).alias("diff"),
        F.round(z, 12).alias("z"),
        F.when(z.isNotNull(), significant(normal_two_sided_p(z))).alias("p_value"),
    )
    return out.withColumn("decision", _decision(F.col("p_value")))


def mann_whitney_margin(m: Model) -> DataFrame:
    """ST2 + ST3: Mann-Whitney U of the margin per initiated line, campaign (A)
    vs normal (B), two-sided, tie- and continuity-corrected, with the
    rank-biserial effect size 1 - 2U/(nA nB).

    No pairwise comparison and no sort of all rows: lines collapse to one row
    per distinct value with (nA, nB) - a two-phase aggregate, so the large
    block of zeros is one row - and the number of B values below each value is
    a distributed running sum over the distinct values.
    U_A = sum_v nA(v) * (B_below(v) + nB(v)/2); tie term sum(t^3 - t).
    """
    g = F.col("sale_group")
    collapsed = _by_value(m, eligible_products(m)).groupBy(F.col("margin_initiated").alias("v")).agg(
        F.coalesce(F.sum(F.when(g == CAMPAIGN, F.col("n"))), F.lit(0)).alias("na"),
        F.coalesce(F.sum(F.when(g == NORMAL, F.col("n"))), F.lit(0)).alias("nb"),
    )
    return mann_whitney(collapsed)


def mann_whitney(collapsed: DataFrame) -> DataFrame:
    """ST2 + ST3 of distinct values ``v`` with their numbers ``na`` and ``nb`` in
    the two groups: the exact distribution of U for small groups without ties,
    else the normal one with corrections for ties and continuity."""
    run = global_running_sum(collapsed, [F.col("v")], {"cum_b": "nb"})
    t = (F.col("na") + F.col("nb")).cast("double")
    s = run.agg(
        F.sum("na").cast("double").alias("n1"),
        F.sum("nb").cast("double").alias("n2"),
        F.sum(F.col("na").cast("double") * ((F.col("cum_b") - F.col("nb")).cast("double")
                                             + F.col("nb").cast("double") / F.lit(2.0))).alias("u_a"),
        F.sum(t * t * t - t).alias("tie"),
    )
    n1, n2, u_a, tie = (F.col(k) for k in ("n1", "n2", "u_a", "tie"))
    n = n1 + n2
    mu = n1 * n2 / F.lit(2.0)
    sigma = F.sqrt(n1 * n2 / F.lit(12.0) * ((n + F.lit(1.0)) - F.try_divide(tie, n * (n - F.lit(1.0)))))
    big_u = F.greatest(u_a, n1 * n2 - u_a)
    z = F.try_divide(big_u - mu - F.lit(0.5), sigma)
    p = F.when(z < 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * normal_upper_tail(z)))
    exact = (tie == 0) & (F.least(n1, n2) >= 1) & (F.least(n1, n2) <= EXACT_GROUP) & (n1 * n2 <= EXACT_PAIRS)
    p = F.when(exact, F.least(F.lit(1.0), F.lit(2.0) * exact_u_tail(big_u, n1, n2))).otherwise(p)
    effect = F.lit(1.0) - F.try_divide(F.lit(2.0) * u_a, n1 * n2)
    label = None
    for name, bound in EFFECT_SIZE_LABELS:
        cond = F.abs(F.col("effect_size")) < bound if bound is not None else None
        if label is None:
            label = F.when(cond, name)
        elif cond is not None:
            label = label.when(cond, name)
        else:
            label = label.otherwise(name)
    out = s.select(
        n1.cast("bigint").alias("n_a"),
        n2.cast("bigint").alias("n_b"),
        u_a.alias("u_stat"),
        F.round(z, 12).alias("z"),
        F.when(z.isNotNull() | exact, significant(p)).alias("p_value"),
        F.round(effect, 12).alias("effect_size"),
    )
    return out.withColumn("effect_label", label).withColumn("decision", _decision(F.col("p_value")))


__all__ = [
    "item_margin", "eligible_products", "campaign_margin_by_product", "campaign_margin_one_product",
    "campaign_margin_pooled", "campaign_summary", "ztest_cancel_rate", "mann_whitney_margin",
]
