"""Global rank and global running sum without a single-task window.

``row_number().over(Window.orderBy(...))`` without ``partitionBy`` moves every
row into one task. Instead:

1. sort globally (range exchange; the order must be total, so ties are broken
   by a key column and no value can pile up in one range partition), tag each
   row with ``monotonically_increasing_id`` (partition index in the high bits,
   position inside the partition in the low 33 bits) and checkpoint the result
   to the shared checkpoint folder, so later passes see the same partitions
   even if an executor is lost in between;
2. per-partition row counts and value sums: one row per partition;
3. exclusive prefix sums and grand totals over those few rows (a window over
   the number of partitions, a bound that does not grow with the data),
   broadcast back;
4. rank = partition offset + position + 1; running sum = partition offset +
   running sum inside the partition.

The grand totals come out of step 3 for free, so callers never need a second
pass over the input to normalise by the total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.config import DEFAULT
from orderlens.operators.joins import checked_broadcast
from orderlens.session import checkpoint_once

_LOW_BITS = (1 << 33) - 1


def _sorted_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    s = df.orderBy(*order).withColumn("_gr_pos", F.monotonically_increasing_id())
    s = checkpoint_once(s)
    return s.withColumn("_gr_pid", F.shiftright(F.col("_gr_pos"), 33))


def _offsets(s: DataFrame, values: dict[str, str]) -> DataFrame:
    totals = s.groupBy("_gr_pid").agg(
        F.count(F.lit(1)).alias("_gr_n"), *[F.sum(v).alias(f"_gr_t_{o}") for o, v in values.items()]
    )
    prev = Window.orderBy("_gr_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cols = [F.coalesce(F.sum("_gr_n").over(prev), F.lit(0)).alias("_gr_off"),
            F.sum("_gr_n").over(whole).alias("_gr_total_n")]
    for o in values:
        cols += [F.coalesce(F.sum(f"_gr_t_{o}").over(prev), F.lit(0)).alias(f"_gr_o_{o}"),
                 F.sum(f"_gr_t_{o}").over(whole).alias(f"_gr_total_{o}")]
    return totals.select("_gr_pid", *cols)


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                total_col: str | None = None) -> DataFrame:
    """Add a 1-based rank in ``order`` (which must be a total order) and,
    optionally, the total row count."""
    s = _sorted_positions(df, order)
    out = s.join(F.broadcast(_offsets(s, {})), "_gr_pid", "inner").withColumn(
        rank_col, F.col("_gr_off") + F.col("_gr_pos").bitwiseAND(F.lit(_LOW_BITS)) + 1)
    if total_col:
        out = out.withColumn(total_col, F.col("_gr_total_n"))
    return out.drop("_gr_pos", "_gr_pid", "_gr_off", "_gr_total_n")


def global_running_sum(
    df: DataFrame, order: Sequence[Column], values: dict[str, str], rank_col: str | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{out_col: value_col}`` in ``order`` (a
    total order); optionally the rank and grand totals ``{total_col: out_col}``."""
    s = _sorted_positions(df, order)
    out = s.join(F.broadcast(_offsets(s, values)), "_gr_pid", "inner")
    # inside one range partition: a window over that partition only (its size
    # is bounded by the range exchange, not by the data as a whole)
    w_in = Window.partitionBy("_gr_pid").orderBy("_gr_pos").rowsBetween(Window.unboundedPreceding, 0)
    for o, v in values.items():
        out = out.withColumn(o, F.col(f"_gr_o_{o}") + F.sum(v).over(w_in))
    if rank_col:
        out = out.withColumn(rank_col, F.col("_gr_off") + F.col("_gr_pos").bitwiseAND(F.lit(_LOW_BITS)) + 1)
    for t, o in (totals or {}).items():
        out = out.withColumn(t, F.col(f"_gr_total_{o}"))
    drop = ["_gr_pos", "_gr_pid", "_gr_off", "_gr_total_n"]
    drop += [f"_gr_o_{o}" for o in values] + [f"_gr_total_{o}" for o in values]
    return out.drop(*drop)


def quintile_from_rank(rank: Column, n: Column, bins: int = 5) -> Column:
    """Bin 1..bins of a 1-based rank, cutting the ranks at linearly
    interpolated quantiles (first bin closed): greatest(1, ceil(bins*(r-1)/(n-1)))
    in integer arithmetic; n = 1 gives bin 1."""
    num = F.lit(bins) * (rank - 1)
    den = n - 1
    ceil_div = ((num + den - 1) - F.pmod(num + den - 1, den)) / den
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), ceil_div.cast("int")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    prefix: str = "q", weight: str | None = None,
                    max_broadcast_bytes: int = DEFAULT.max_broadcast_bytes) -> DataFrame:
    """Exact quantiles with linear interpolation (the ``quantile_cont`` /
    ``percentile`` definition) per group, without holding any group's values
    in one task.

    Rows collapse to (group, value, count) with a two-phase aggregate; a
    distributed running sum of the counts over (group, value) gives every
    distinct value its position range [prev, cum); the positions
    floor/ceil(p (n - 1)) of each group are matched against those ranges and
    interpolated: lo + (hi - lo) * frac. Without groups n is the grand total
    of the same pass; with groups the per-group start and size come from an
    aggregate and are joined on the group columns. Returns one row per group
    with columns ``{prefix}_{p}``. ``weight`` names a count column when the
    input is already collapsed to (group, value, count) rows.
    """
    groups = list(group_cols)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("_eq_c"))
    order = [*(F.col(g).asc_nulls_first() for g in groups), F.col(value)]
    if groups:
        run = global_running_sum(counts, order, {"_eq_cum": "_eq_c"})
        run = run.withColumn("_eq_prev", F.col("_eq_cum") - F.col("_eq_c"))
        spans = run.groupBy(*groups).agg(F.min("_eq_prev").alias("_eq_start"), F.sum("_eq_c").alias("_eq_n"))
        spans = spans.select(*[F.col(g).alias(f"_eq_t_{g}") for g in groups], "_eq_start", "_eq_n")
        # one row per group, read from the checkpointed running sums: measured,
        # then broadcast when small (a shuffle join otherwise)
        spans, _ = checked_broadcast(spans, max_broadcast_bytes)
        keys = [F.col(g).eqNullSafe(F.col(f"_eq_t_{g}")) for g in groups]
        run = run.join(spans, keys, "inner").drop(*[f"_eq_t_{g}" for g in groups])
    else:
        run = global_running_sum(counts, order, {"_eq_cum": "_eq_c"}, totals={"_eq_n": "_eq_cum"})
        run = run.withColumn("_eq_prev", F.col("_eq_cum") - F.col("_eq_c")).withColumn("_eq_start", F.lit(0))
    x = run.select(*groups, value, "_eq_prev", "_eq_cum", "_eq_start", "_eq_n",
                   F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_eq_p"))
    pos = F.col("_eq_p") * (F.col("_eq_n") - 1)
    x = x.select(
        *groups, value, "_eq_prev", "_eq_cum", "_eq_p",
        (F.col("_eq_start") + F.floor(pos)).alias("_eq_lo"),
        (F.col("_eq_start") + F.ceil(pos)).alias("_eq_hi"),
        (pos - F.floor(pos)).alias("_eq_frac"),
    )
    hit = (F.col("_eq_prev") <= F.col("_eq_lo")) & (F.col("_eq_lo") < F.col("_eq_cum"))
    hit_hi = (F.col("_eq_prev") <= F.col("_eq_hi")) & (F.col("_eq_hi") < F.col("_eq_cum"))
    x = x.where(hit | hit_hi).select(
        *groups, "_eq_p", "_eq_frac",
        F.when(hit, F.col(value)).alias("_eq_vlo"), F.when(hit_hi, F.col(value)).alias("_eq_vhi"),
    )
    per_p = x.groupBy(*groups, "_eq_p").agg(
        F.max("_eq_vlo").cast("double").alias("_eq_vlo"), F.max("_eq_vhi").cast("double").alias("_eq_vhi"),
        F.max("_eq_frac").alias("_eq_frac"),
    ).withColumn("_eq_q", F.col("_eq_vlo") + (F.col("_eq_vhi") - F.col("_eq_vlo")) * F.col("_eq_frac"))
    out = per_p.groupBy(*groups).pivot("_eq_p", [float(p) for p in probs]).agg(F.first("_eq_q"))
    return out.select(*groups, *[F.col(f"`{float(p)}`").alias(f"{prefix}_{p}") for p in probs])
