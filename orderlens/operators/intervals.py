"""Interval join: points in windows, for window tables of any size.

A window of n days belongs to the level of the least power of two that is not
under n; time is cut into buckets of that width, and a window touches two of its
level's buckets at most. A point is in one bucket of each level that some window
has. So point and window meet in an equi-join on (level, bucket), which Spark
shuffles or broadcasts as it does any other, and an exact comparison drops the
pairs that only share a bucket (a window fills more than an eighth of the days of
its two buckets). No window is exploded into days and no nested loop is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _days(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def _level(low: Column, high: Column) -> Column:
    """Least k with 2^k >= number of days."""
    n = F.datediff(high, low) + 1
    return F.length(F.bin(n - 1)) * (n > 1).cast("int")


def _bucket(days: Column, level: Column) -> Column:
    return F.floor(days / F.pow(F.lit(2.0), level)).cast("bigint")


def interval_join(points: DataFrame, date: str, windows: DataFrame, low: str, high: str, how: str = "inner") -> DataFrame:
    """``points`` with the windows that hold their ``date`` (``low`` and ``high``
    inclusive; ``how`` is inner, left_semi or left_anti). Windows that end before
    they begin, or lack an end, hold nothing; a point without a date lies in none."""
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("how is inner, left_semi or left_anti")
    lo, hi = F.col(low), F.col(high)
    keyed = windows.where(lo <= hi).withColumn("_ij_level", _level(lo, hi))
    levels = [r["_ij_level"] for r in keyed.select("_ij_level").distinct().collect()]  # as many as powers of two at most
    ends = F.array_distinct(F.array(*[_bucket(_days(c), F.col("_ij_level")) for c in (lo, hi)]))
    keyed = keyed.withColumn("_ij_bucket", F.explode(ends)).withColumnsRenamed({low: "_ij_low", high: "_ij_high"})
    level = F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("_ij_level")
    if how == "inner":
        spread = points.select("*", level).withColumn("_ij_bucket", _bucket(_days(F.col(date)), F.col("_ij_level")))
        met = spread.join(keyed, ["_ij_level", "_ij_bucket"]).where(F.col(date).between(F.col("_ij_low"), F.col("_ij_high")))
        return met.drop("_ij_level", "_ij_bucket").withColumnsRenamed({"_ij_low": low, "_ij_high": high})
    # dates are few against points: the dates in some window, then an equi-join
    inside = interval_join(points.select(F.col(date).alias("_ij_date")).distinct(), "_ij_date", windows.select(low, high), low, high)
    inside = inside.select(F.col("_ij_date").alias(date)).distinct()
    return points.join(inside, date, how)


def with_inside(points: DataFrame, date: str, windows: DataFrame, low: str, high: str, flag: str) -> DataFrame:
    """Distinct rows of ``points`` with a flag: does some window hold their date?
    The points are read once."""
    keyed = windows.where(F.col(low) <= F.col(high)).withColumn("_ij_level", _level(F.col(low), F.col(high)))
    levels = [r["_ij_level"] for r in keyed.select("_ij_level").distinct().collect()]
    ends = F.array_distinct(F.array(*[_bucket(_days(F.col(c)), F.col("_ij_level")) for c in (low, high)]))
    keyed = keyed.select("_ij_level", F.explode(ends).alias("_ij_bucket"), F.col(low).alias("_ij_low"), F.col(high).alias("_ij_high"))
    level = F.explode_outer(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("_ij_level")
    spread = points.select("*", level).withColumn("_ij_bucket", _bucket(_days(F.col(date)), F.col("_ij_level")))
    near = (spread["_ij_level"] == keyed["_ij_level"]) & (spread["_ij_bucket"] == keyed["_ij_bucket"])
    met = spread.join(keyed, near & spread[date].between(keyed["_ij_low"], keyed["_ij_high"]), "left")
    return met.groupBy(*[spread[c] for c in points.columns]).agg(F.bool_or(keyed["_ij_low"].isNotNull()).alias(flag))
