"""Cleaning of the marketplace export (CL1-CL16).

Every step is a projection or an aggregate over the labelled union; personal
columns are dropped first, so column pruning keeps them out of the scan of
every later query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.config import COMPLETED_STATUSES, DEFAULT, Params
from orderlens.functions.calendar import parse_export_timestamp

DATE_COLUMNS = {
    "created_raw": "created_at", "updated_raw": "updated_at", "delivered_raw": "delivered_at", "promised_raw": "promised_at",
}
DISCOUNT_COLUMNS = {"seller_discount_raw": "seller_discount", "platform_discount_raw": "platform_discount"}
NUMERIC_COLUMNS = {
    "unit_price_raw": "unit_price", "paid_price": "paid_price", "shipping_fee": "shipping_fee",
    "bundle_discount_raw": "bundle_discount",
}


def drop_columns(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """CL1 + CL2: personal columns, then the known all-empty columns
    (``drop`` ignores names a source does not have)."""
    return df.drop(*params.pii_columns).drop(*params.empty_columns)


def completed_flag(status: Column) -> Column:
    """CL7: completed iff the status is in the completed set; null -> False."""
    return F.coalesce(status.isin(*COMPLETED_STATUSES), F.lit(False))


def whole_units(c: Column) -> Column:
    """A number or its text (``75000.0``, ``1e5``, ``-12.5``) in whole minor
    units, halves rounded away from zero; null if it isn't a number."""
    return F.round(c.try_cast("decimal(38,6)"), 0).try_cast("bigint")


def money_discount(c: Column) -> Column:
    """CL5: discounts arrive negative and null when zero."""
    return F.abs(F.coalesce(whole_units(c), F.lit(0).cast("bigint")))


def money_numeric(c: Column) -> Column:
    """CL6: anything -> bigint, unparseable -> null -> 0."""
    return F.coalesce(whole_units(c), F.lit(0).cast("bigint"))


def money_failure_counts(raw: DataFrame) -> DataFrame:
    """CL5 + CL6: per money column of the raw export, values that are present
    but no number, and so count as 0 after cleaning."""
    names = {c: n for c, n in {**DISCOUNT_COLUMNS, **NUMERIC_COLUMNS}.items() if c in raw.columns}
    one = raw.agg(*[F.count_if(F.col(c).isNotNull() & whole_units(F.col(c)).isNull()).alias(n) for c, n in names.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names.values())
    return one.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, n_fail)")


def clean_orders(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The full cleaning step: drop, parse, fix signs, coerce, flag."""
    df = drop_columns(raw, params)
    cols = []
    for c in df.columns:
        if c in DATE_COLUMNS:
            cols += [F.col(c), parse_export_timestamp(F.col(c)).alias(DATE_COLUMNS[c])]
        elif c in DISCOUNT_COLUMNS:
            cols.append(money_discount(F.col(c)).alias(DISCOUNT_COLUMNS[c]))
        elif c in NUMERIC_COLUMNS:
            cols.append(money_numeric(F.col(c)).alias(NUMERIC_COLUMNS[c]))
        elif c == "status_raw":
            cols += [F.col(c).alias("status"), completed_flag(F.col(c)).alias("is_completed")]
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def null_ratio_profile(df: DataFrame) -> DataFrame:
    """CL2: (column_name, pct_null, n_non_null) for every column, in one pass."""
    aggs = []
    for c in df.columns:
        aggs += [
            F.avg(F.col(c).isNull().cast("int")).alias(f"p__{c}"),
            F.count(F.col(c)).alias(f"n__{c}"),
        ]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `p__{c}` * 100.0D, `n__{c}`" for c in df.columns)
    return one.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, pct_null, n_non_null)")


def parse_failure_counts(df: DataFrame) -> DataFrame:
    """CL4: per date column, values present in the raw text but null after parsing."""
    dates = {raw: parsed for raw, parsed in DATE_COLUMNS.items() if raw in df.columns}
    one = df.agg(*[F.count_if(F.col(raw).isNotNull() & F.col(parsed).isNull()).alias(parsed) for raw, parsed in dates.items()])
    pairs = ", ".join(f"'{p}', `{p}`" for p in dates.values())
    return one.selectExpr(f"stack({len(dates)}, {pairs}) AS (column_name, n_fail)")


def value_counts(df: DataFrame, col: str, extra=()) -> DataFrame:
    """CL8: (value, n, pct) over non-null values; the percentage is of *all*
    rows (the denominator includes nulls). One aggregate by value (null is a
    group), then the total as a window over those few categorical rows - no
    second pass over the data."""
    agg = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"), *extra)
    return agg.withColumn(
        "pct", F.lit(100.0) * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy())
    ).where(F.col(col).isNotNull())


def case_variants(df: DataFrame, col: str) -> DataFrame:
    """CL14: folded value -> number of distinct spellings, where > 1."""
    folded = F.lower(F.trim(F.col(col)))
    return (
        df.where(F.col(col).isNotNull())
        .select(folded.alias("folded_value"), F.col(col))
        .distinct()
        .groupBy("folded_value")
        .agg(F.count(F.lit(1)).alias("n_variants"))
        .where(F.col("n_variants") > 1)
    )


def normalise_category(c: Column, canonical: tuple) -> Column:
    """CL13: lower(trim(value)) == key -> canonical spelling, else unchanged."""
    folded = F.lower(F.trim(c))
    expr = None
    for key, canon in canonical:
        expr = F.when(folded == key, F.lit(canon)) if expr is None else expr.when(folded == key, F.lit(canon))
    return c if expr is None else expr.otherwise(c)


def empty_columns(df: DataFrame) -> list[str]:
    """CL2, automatic: the columns without a single non-null value, from one
    aggregate pass (one row per column reaches the driver, never data rows)."""
    rows = null_ratio_profile(df).where(F.col("n_non_null") == 0).select("column_name").collect()
    return [r.column_name for r in rows]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop every column that is null in all rows."""
    return df.drop(*empty_columns(df))
