"""Ingest and cleaning of the raw export (IO1, IO2, IO5, CL1-CL16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.config import EXPORT_COLUMNS
from orderlens.operators import clean as cl
from orderlens.operators.model import ORDER_KEY, Model, observed_stages
from orderlens.session import scratch_path
from orderlens.sources.exports import read_csv_checked, reject_counts
from orderlens.sources.io import export_csv_roundtrip


def _raw(m: Model) -> DataFrame:
    return m.raw


def _clean(m: Model) -> DataFrame:
    return cl.clean_orders(_raw(m), m.params)


def ingest_union_labelled(m: Model) -> DataFrame:
    """IO1 (+CL1): both shops' exports, labelled with the shop, personal
    columns dropped before anything else."""
    return _raw(m).drop(*m.params.pii_columns)


def _damaged_exports(m: Model) -> dict[str, str]:
    """Both shops' exports as CSV files with a header each, in which the first
    lines of some orders have a quote, a field too few or a field too many."""
    raw = _raw(m).select("shop", *[F.col(name).cast("string").alias(c) for c, name in EXPORT_COLUMNS.items()])
    names = list(EXPORT_COLUMNS)
    text = lambda columns: F.to_csv(F.struct(*[F.col(c) for c in columns]))
    first, order = F.col("orderItemId") == "1", F.col("orderNumber").cast("bigint")
    line = (
        F.when(first & (order % 61 == 0), F.concat(F.lit('"'), text(names)))
        .when(first & (order % 59 == 0), text(names[:-1]))
        .when(first & (order % 53 == 0), F.concat(text(names), F.lit(",x")))
        .otherwise(text(names)))
    lines = raw.select("shop", line.alias(",".join(names)))
    base = scratch_path(m.spark, "damaged-exports")
    lines.write.partitionBy("shop").options(header=True, sep="\x01", quote="", escapeQuotes=False).csv(base)
    # the shops are those of the written folders: the files are listed, not read, and the lines not built again
    folders = m.spark.read.format("binaryFile").load(base).select("shop").distinct()
    return {shop: f"{base}/shop={shop}" for shop in (r["shop"] for r in folders.collect())}


def ingest_rejects(m: Model) -> DataFrame:
    """IO1: exports with malformed lines, written and read back: rows taken and
    lines set aside for each shop and reason."""
    checked = {shop: read_csv_checked(m.spark, path, shop, "reject") for shop, path in _damaged_exports(m).items()}
    rows = [e.rows.select(F.lit(shop).alias("shop")) for shop, e in checked.items()]
    rejects = [e.rejects for e in checked.values()]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return reject_counts(union(rows), union(rejects))


def ingest_profile(m: Model) -> DataFrame:
    """IO2: rows and distinct order numbers per shop plus the grand total
    (``rollup``: the total row has a null shop)."""
    return _raw(m).rollup("shop").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("order_number").alias("n_orders"))


def export_csv(m: Model) -> DataFrame:
    """IO5: the cleaned lines written as CSV to the shared scratch folder and
    read back, every value as it was."""
    return export_csv_roundtrip(m.spark, _clean(m).drop(*cl.DATE_COLUMNS))


def stage_report(m: Model) -> DataFrame:
    """IO2, CL2, CL4, CL6, SK5, SM12: what the writes of the stages have observed."""
    return observed_stages(m, scratch_path(m.spark, "stages"))[1]


def clean_drop_columns(m: Model) -> DataFrame:
    """CL1 + CL2: the union without personal and all-empty columns."""
    return cl.drop_columns(_raw(m), m.params)


def null_ratio_profile(m: Model) -> DataFrame:
    """CL2: the null profile that decides which columns are empty."""
    return cl.null_ratio_profile(_raw(m).drop(*m.params.pii_columns))


def clean_parse_dates(m: Model) -> DataFrame:
    """CL3: export timestamps parsed (bad text -> null)."""
    return _clean(m).select("order_number", "line_number", "shop", *cl.DATE_COLUMNS, *cl.DATE_COLUMNS.values())


def parse_failure_counts(m: Model) -> DataFrame:
    """CL4."""
    return cl.parse_failure_counts(_clean(m))


def clean_money(m: Model) -> DataFrame:
    """CL5 + CL6: discount signs fixed, numeric coercion, nulls -> 0."""
    return _clean(m).select(
        "order_number", "line_number", "shop", "unit_price", "seller_discount",
        "platform_discount", "paid_price", "shipping_fee", "bundle_discount")


def money_failure_counts(m: Model) -> DataFrame:
    """CL5 + CL6: values of each money column that are no number."""
    return cl.money_failure_counts(_raw(m))


def status_distribution(m: Model) -> DataFrame:
    """CL7 + CL8: status value counts with percent of all rows."""
    return cl.value_counts(_clean(m), "status", [F.bool_or("is_completed").alias("is_completed")])


def row_incomplete_rate(m: Model) -> DataFrame:
    """CL9: share of lines that are not completed."""
    return _clean(m).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.lit(100.0) * F.avg((~F.col("is_completed")).cast("int"))).alias("pct_incomplete_rows"),
    )


def multi_line_order_sample(m: Model) -> DataFrame:
    """CL10: the lowest order number with more than one line, and its lines."""
    c = _clean(m)
    first = (
        c.groupBy("order_number").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).select(F.min("order_number")).scalar()
    )
    return c.where(F.col("order_number") == first).select(
        "order_number", "line_number", "shop", "seller_sku", "unit_price", "paid_price", "shipping_fee")


def price_identity_check(m: Model) -> DataFrame:
    """CL11: paid = list + shipping - seller discount - platform discount on
    the lines that carry a discount."""
    f = m.fact
    disc = (F.col("seller_discount") > 0) | (F.col("platform_discount") > 0)
    ok = F.col("paid_price") == (F.col("unit_price") + F.col("shipping_fee")
                                 - F.col("seller_discount") - F.col("platform_discount"))
    return f.agg(F.count_if(disc).alias("n_rows"), F.count_if(disc & ok).alias("n_ok"))


def order_allocation_sums(m: Model) -> DataFrame:
    """CL12: per order, the sums of list price, shipping and paid price."""
    return m.fact.groupBy(*ORDER_KEY).agg(
        F.sum("unit_price").alias("sum_unit_price"),
        F.sum("shipping_fee").alias("sum_shipping_fee"),
        F.sum("paid_price").alias("sum_paid_price"),
    )


def case_variant_report(m: Model) -> DataFrame:
    """CL14: carrier spellings that differ only by case or spaces."""
    return cl.case_variants(m.items, "carrier")


def cross_shop_orders(m: Model) -> DataFrame:
    """CL15: order numbers used by more than one shop."""
    return (
        m.items.groupBy("order_number").agg(F.count_distinct("shop").alias("n_shops"))
        .where(F.col("n_shops") > 1)
    )


def order_size_gaps(m: Model) -> DataFrame:
    """CL16: orders per item count and the gap to the next larger item count
    (a window over the distinct item counts: bounded by the largest order)."""
    dist = m.dim_order.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_orders"))
    w = Window.orderBy("n_items")
    return dist.withColumn("gap_to_next", F.lead("n_items").over(w) - F.col("n_items"))
