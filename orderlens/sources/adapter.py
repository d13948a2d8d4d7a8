"""Adapter: the driver's TPC-H-style tables -> marketplace order-item tables.

The order-item schema of the analyses (one row per order line, no quantity
column, money in whole minor units) is derived from ``lineitem`` joined to
``part`` and ``orders``. Every derived value is a deterministic Column
expression, so the same rows come out of the DuckDB oracle (see
``orderlens.plans.oracle``).

Join order matters for the physical plan: ``orders`` has about a quarter of
the line count, so it is never a broadcast candidate at scale; it is joined
with a sort-merge join, which leaves the lines hash-partitioned by order key,
and every later (order, shop) aggregate, the customer-order semi-join and the
order-level join-backs reuse that partitioning instead of shuffling the lines
again. ``part`` is joined after it as a broadcast when a check of its bytes
shows it is small (its strings then stay out of the line shuffle), else before it as
its own shuffle join, so the orders join still comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.config import DEFAULT
from orderlens.operators.joins import checked_broadcast
from orderlens.sources.io import read_table

# --- fixed adapter values ---------------------------------------------------
SHOP_LABELS = ("shop_a", "shop_b")  # by l_suppkey % 2
# carrier spelling by l_suppkey % 7 (case and space variants, one null)
CARRIERS = ("Falcon", "falcon ", "Heron", "Ibis", "Kite", "Swift", None)
CARRIER_TYPES = ("pickup", "dropoff")  # by l_suppkey % 2
# SKU suffix by line number 1..5, none after
SKU_SUFFIXES = ("-FS", "FS2", "-SL", "-1sticker", " - fs3")
# failure reason of returned lines by l_linenumber % 4
FAIL_REASONS = ("too_slow", "duplicate", "unpaid", None)
# bundle discount of the lines with (order + line) % 101 = 0
BUNDLE_DISCOUNT = 5000
# codes without a known cost
BRANDS_WITHOUT_COST = ("Brand#3", "Brand#7")
# columns of the labelled raw union once the personal columns are dropped
RAW_COLUMNS = (
    "order_number", "line_number", "seller_sku", "item_name", "status_raw", "pay_method", "carrier",
    "carrier_type", "fail_reason", "unit_price_raw", "seller_discount_raw", "platform_discount_raw",
    "shipping_fee", "paid_price", "created_raw", "warehouse", "shop",
    "bundle_discount_raw", "fail_detail", "updated_raw", "delivered_raw", "promised_raw",
)
# ---------------------------------------------------------------------------


def _pick(index: Column, values) -> Column:
    """values[index] as a CASE expression (index is a small integer column)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def _idiv(a: Column, n: int) -> Column:
    """Integer division of a non-negative bigint (exact, no double rounding)."""
    return ((a - a % n) / n).cast("bigint")


def _joined(spark: SparkSession, sf_dir: str, max_broadcast_bytes: int = DEFAULT.max_broadcast_bytes) -> DataFrame:
    """lineitem joined to part and orders.

    When ``part`` is small enough to broadcast (a check of its bytes), it is joined *after* the orders sort-merge join: its string
    columns then never travel through the line shuffle, and the broadcast
    join keeps the order-key partitioning. A large ``part`` is joined first
    (its own shuffle join on the part key), so that the orders join still
    comes last and leaves the lines partitioned by order key.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    part_b, small = checked_broadcast(part, max_broadcast_bytes)
    if small:
        x = li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey, "inner")
        return x.join(part_b, x.l_partkey == part_b.p_partkey, "inner")
    x = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return x.join(orders.hint("merge"), x.l_orderkey == orders.o_orderkey, "inner")


def order_items(spark: SparkSession, sf_dir: str, max_broadcast_bytes: int = DEFAULT.max_broadcast_bytes) -> DataFrame:
    """Clean order-item lines (the input of SKU parsing and the model)."""
    x = _joined(spark, sf_dir, max_broadcast_bytes)

    ln = F.col("l_linenumber")
    suffix = F.coalesce(_pick(ln - 1, SKU_SUFFIXES), F.lit(""))
    returned = F.col("l_returnflag") == "R"
    status = (
        F.when(returned, F.when(ln % 2 == 1, "canceled").otherwise("returned"))
        .when(F.col("l_linestatus") == "F", "delivered")
        .otherwise("confirmed")
    )
    unit_price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    disc_pct = F.round(F.col("l_discount") * 100).cast("bigint")
    tax_pct = F.round(F.col("l_tax") * 100).cast("bigint")
    created_at = F.timestamp_add("MINUTE", F.col("l_orderkey") % 1440, F.col("o_orderdate"))

    out = x.select(
        F.col("l_orderkey").alias("order_number"),
        ln.alias("line_number"),
        _pick(F.col("l_suppkey") % 2, SHOP_LABELS).alias("shop"),
        F.col("l_partkey").alias("part_id"),
        F.concat(
            F.when((F.col("l_orderkey") % 97 == 0) & (ln == 1), "unlisted").otherwise(F.col("p_brand")),  # no such code
            F.lit("-"), F.col("p_type"), suffix,
        ).alias("seller_sku"),
        F.concat(F.lit("["), F.col("p_type"), F.lit("] "), F.col("p_name")).alias("item_name"),
        status.alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CARD")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .otherwise("COD").alias("pay_method"),
        _pick(F.col("l_suppkey") % 7, CARRIERS).alias("carrier"),
        _pick(F.col("l_suppkey") % 2, CARRIER_TYPES).alias("carrier_type"),
        F.when(returned, _pick(ln % 4, FAIL_REASONS)).alias("fail_reason"),
        unit_price.alias("unit_price"),
        _idiv(unit_price * disc_pct, 100).alias("seller_discount"),
        _idiv(unit_price * tax_pct, 200).alias("platform_discount"),
        (F.round(F.col("l_quantity")).cast("bigint") * 1000).alias("shipping_fee"),
        F.when((F.col("l_orderkey") + ln) % 101 == 0, BUNDLE_DISCOUNT).otherwise(0).cast("bigint").alias("bundle_discount"),
        created_at.alias("created_at"),
        F.col("l_orderkey").alias("_k"),
    )
    completed = F.col("status").isin("confirmed", "delivered")
    return out.select(
        "order_number", "line_number", "shop", "part_id", "seller_sku", "item_name",
        "status", "pay_method", "carrier", "carrier_type", "fail_reason",
        F.concat(F.lit("told: "), F.col("fail_reason")).alias("fail_detail"),
        "unit_price", "seller_discount", "platform_discount", "bundle_discount", "shipping_fee",
        (F.col("unit_price") + F.col("shipping_fee") - F.col("seller_discount")
         - F.col("platform_discount") - F.col("bundle_discount")).alias("paid_price"),
        "created_at",
        F.timestamp_add("MINUTE", (F.col("_k") * 7 + F.col("line_number") * 131) % 4000,
                        F.col("created_at")).alias("updated_at"),
        F.when(completed, F.timestamp_add("DAY", (F.col("_k") * 3 + F.col("line_number")) % 20,
                                          F.col("created_at"))).alias("delivered_at"),
        F.timestamp_add("DAY", F.lit(2), F.col("created_at")).alias("promised_at"),
    )


def raw_order_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The same lines in the export's dirty form, one frame per shop.

    Dates are strings ('dd MMM yyyy HH:mm', some null, some unparseable),
    discounts negative and null when zero, the list price a string with 'n/a'
    on line 7, some statuses null, two personal columns from ``customer`` and an
    all-null ``warehouse`` column that only the first shop's export has. The
    shop label is not a column: the labelled ingest adds it.
    """
    items = order_items(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # one row per order (order keys are unique): grouped by the join key, so
    # Catalyst knows the side is unique and drops the whole join - customer
    # is never read - in every query that drops the personal columns
    people = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        .groupBy(F.col("o_orderkey").alias("order_number"))
        .agg(F.max("c_name").alias("customer_name"), F.max("c_mktsegment").alias("customer_segment"))
    )
    k = F.col("order_number")
    raw = items.join(people.hint("merge"), "order_number", "left").select(
        "order_number", "line_number", "shop", "seller_sku", "item_name",
        F.when(k % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("status")).alias("status_raw"),
        "pay_method", "carrier", "carrier_type", "fail_reason",
        F.when(F.col("line_number") == 7, F.lit("n/a"))
        .when(F.col("line_number") == 6, F.concat(F.col("unit_price").cast("string"), F.lit(".00")))
        .otherwise(F.col("unit_price").cast("string")).alias("unit_price_raw"),
        F.when(F.col("seller_discount") != 0, -F.col("seller_discount")).alias("seller_discount_raw"),
        F.when(F.col("platform_discount") != 0, -F.col("platform_discount")).alias("platform_discount_raw"),
        F.when(F.col("bundle_discount") != 0, F.col("bundle_discount").cast("string")).alias("bundle_discount_raw"),
        "fail_detail", "shipping_fee", "paid_price",
        F.when(k % 89 == 0, F.lit(None).cast("string"))
        .when(k % 97 == 0, F.lit("bad"))
        .otherwise(F.date_format("created_at", "dd MMM yyyy HH:mm")).alias("created_raw"),
        F.when(k % 83 == 0, F.lit("")).otherwise(F.date_format("updated_at", "dd MMM yyyy HH:mm")).alias("updated_raw"),
        F.date_format("delivered_at", "dd MMM yyyy HH:mm").alias("delivered_raw"),
        F.when(k % 79 == 0, F.date_format("promised_at", "yyyy-MM-dd"))
        .otherwise(F.date_format("promised_at", "dd MMM yyyy HH:mm")).alias("promised_raw"),
        "customer_name", "customer_segment",
    )
    a = raw.where(F.col("shop") == SHOP_LABELS[0]).drop("shop").withColumn(
        "warehouse", F.lit(None).cast("string"))
    b = raw.where(F.col("shop") == SHOP_LABELS[1]).drop("shop")
    return [(SHOP_LABELS[0], a), (SHOP_LABELS[1], b)]


def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base-code list (code, ordinal): one code per brand, ordinal = the
    brand's first part key, i.e. its position in the part list."""
    part = read_table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_partkey").alias("ordinal"))


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product cost (product_code, cost) in minor units; two codes have none."""
    part = read_table(spark, sf_dir, "part")
    return (
        part.where(~F.col("p_brand").isin(*BRANDS_WITHOUT_COST))
        .groupBy(F.col("p_brand").alias("product_code"))
        .agg(F.round(F.min("p_retailprice") * 100).cast("bigint").alias("cost"))
    )
