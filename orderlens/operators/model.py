"""Star-schema build (SM1-SM8) and its checks (SM9-SM14).

``Model`` holds the lazy DataFrames of one data folder; each table is built on
first use, so a query only plans (and scans) what it references. Nothing is
cached between queries: every query is a single Catalyst plan from the scan.

Keys: the fact's grain is the order line (order_number, line_number); the
order dimension's key is (order_number, shop), because one order number can
span two shops.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orderlens.config import ADAPTER, DEFAULT, Params
from orderlens.functions.calendar import weekday0, year_month
from orderlens.functions.sku import campaign_flag, has_gift, promo_label
from orderlens.operators.clean import (
    DATE_COLUMNS, DISCOUNT_COLUMNS, NUMERIC_COLUMNS, clean_orders, completed_flag, normalise_category, whole_units,
)
from orderlens.operators.joins import checked_broadcast
from orderlens.operators.prefix_match import with_product_code
from orderlens.session import check_session
from orderlens.sources import adapter
from orderlens.sources.exports import REJECTS, Export
from orderlens.sources.io import checked_export, ingest_labelled

ORDER_KEY = ["order_number", "shop"]

FACT_COLUMNS = [
    "order_number", "line_number", "shop", "part_id", "product_code", "campaign_flag",
    "has_gift", "promo_label", "status", "is_completed", "unit_price", "paid_price",
    "shipping_fee", "seller_discount", "platform_discount", "carrier", "carrier_type",
    "fail_reason", "order_date", "created_at", "updated_at", "delivered_at",
    "bundle_discount", "fail_detail", "promised_at",
]


def with_completed(items: DataFrame) -> DataFrame:
    """CL7 on the adapter's clean lines."""
    return items.withColumn("is_completed", completed_flag(F.col("status")))


def parse_orders(items: DataFrame, codes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """SK1-SK4 + SK8: add product code, campaign flag, gift flag and promo
    label; drop the item name once the label is out."""
    df = items if "is_completed" in items.columns else with_completed(items)
    df = with_product_code(df, codes, "seller_sku", "product_code",
                           max_bytes=params.max_broadcast_bytes)
    return (
        df.withColumn("campaign_flag", campaign_flag(F.col("seller_sku")))
        .withColumn("has_gift", has_gift(F.col("seller_sku")))
        .withColumn("promo_label", promo_label(F.col("item_name")))
        .drop("item_name")
    )


def fact_order_item(parsed: DataFrame, params: Params = DEFAULT, extra: tuple[str, ...] = ()) -> DataFrame:
    """SM1: projection, carrier spelling fix, timestamp -> order date. ``extra``
    columns are kept besides the fact's own."""
    return parsed.select(
        *[
            normalise_category(F.col("carrier"), params.carrier_canonical).alias("carrier")
            if c == "carrier"
            else F.to_date("created_at").alias("order_date")
            if c == "order_date"
            else F.col(c)
            for c in FACT_COLUMNS + [c for c in extra if c not in FACT_COLUMNS]
        ]
    )


DIM_ORDER_COLUMNS = [
    "order_number", "shop", "pay_method", "created_at", "order_date", "n_items", "n_items_completed", "is_completed",
    "total_unit_price", "total_paid_price", "total_shipping_fee", "total_seller_discount", "total_platform_discount", "is_bulk",
]
_SUMMED = ("unit_price", "paid_price", "shipping_fee", "seller_discount", "platform_discount")


def dim_order(parsed: DataFrame, params: Params = DEFAULT, spans: bool = False) -> DataFrame:
    """SM2 + SM3: one row per (order_number, shop); with ``spans`` also the day
    of its last line and the number of lines without a date.

    ``max(pay_method)`` is the deterministic, null-skipping pick of the order's
    pay method. A string in an aggregation buffer forces Spark's sort-based
    aggregate (every line sorted twice), so the aggregate runs in two levels:
    all numeric measures by (order, shop, pay_method) as a hash aggregate with
    map-side partial sums, then the string max over the already-collapsed rows
    (about one per order). Both levels are satisfied by a hash partitioning on
    the order number, so when the lines arrive partitioned by order (a shuffle
    join with ``orders``) neither level adds an exchange.
    """
    last = F.max("created_at").alias("last_created_at")
    undated = F.count_if(F.col("created_at").isNull()).alias("n_undated")
    lvl1 = parsed.groupBy(*ORDER_KEY, "pay_method").agg(
        *([last, undated] if spans else []),
        F.min("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.col("is_completed").cast("bigint")).alias("n_items_completed"),
        F.bool_and("is_completed").alias("is_completed"),
        *[F.sum(c).alias(f"total_{c}") for c in _SUMMED],
    )
    n = F.sum("n_items")
    return lvl1.groupBy(*ORDER_KEY).agg(
        F.max("pay_method").alias("pay_method"),
        F.min("created_at").alias("created_at"),
        F.to_date(F.min("created_at")).alias("order_date"),
        n.alias("n_items"),
        F.sum("n_items_completed").alias("n_items_completed"),
        F.bool_and("is_completed").alias("is_completed"),
        *[F.sum(f"total_{c}").alias(f"total_{c}") for c in _SUMMED],
        (n >= params.bulk_threshold).alias("is_bulk"),
        *([F.to_date(F.max("last_created_at")).alias("last_order_date"), F.sum("n_undated").alias("n_undated")] if spans else []),
    )


def dim_order_customer(orders: DataFrame) -> DataFrame:
    """SM4: orders that are customer demand (bulk orders removed)."""
    return orders.where(~F.col("is_bulk")).drop("is_bulk")


def fact_order_item_customer(fact: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """SM5: fact lines of orders that are no bulk orders.

    Lines are counted per order from the key columns alone; only the keys of
    bulk orders remain, a few hundredths of all orders, and an anti-join on
    both of them removes their lines. So the side that meets the lines stays
    small (Spark broadcasts it by its measured size, or shuffles it and splits
    a skewed partition), and a hot order is one row of it. Lines without an
    order key belong to no order.
    """
    sizes = fact.select(*ORDER_KEY).groupBy(*ORDER_KEY).agg(F.count(F.lit(1)).alias("n"))
    return without_orders(fact, sizes.where(F.col("n") >= params.bulk_threshold))


def without_orders(fact: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines that have an order key and belong to none of ``orders``."""
    keyed = fact.where(" AND ".join(f"{k} IS NOT NULL" for k in ORDER_KEY))
    return keyed.join(orders.select(*ORDER_KEY), ORDER_KEY, "left_anti")


def dim_product(parsed: DataFrame, cost: DataFrame) -> DataFrame:
    """SM6: every product code in use (null kept, as SELECT DISTINCT does) with
    its cost, null when the cost table has none. The cost table is joined by
    Spark's size-based choice (broadcast when small)."""
    codes = parsed.select("product_code").distinct()
    return codes.join(cost.select("product_code", "cost"), "product_code", "left")


def calendar(dates: DataFrame) -> DataFrame:
    """Calendar fields of a (date) frame."""
    d = F.col("date")
    return dates.select(
        d,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.quarter(d).alias("quarter"),
        year_month(d).alias("year_month"),
        weekday0(d).alias("day_of_week"),
    )


def date_spine(bounds: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Every day from lo to hi inclusive; the frame has one (lo, hi) row."""
    return bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("INTERVAL 1 DAY"))).alias("date"))


def dim_date(parsed: DataFrame) -> DataFrame:
    """SM7: dense daily calendar between the first and last order date.

    Its size is the number of days in the data's range, independent of the
    number of rows, so joining it is always a broadcast.
    """
    bounds = parsed.agg(F.min(F.to_date("created_at")).alias("lo"), F.max(F.to_date("created_at")).alias("hi"))
    return calendar(date_spine(bounds))


def dim_shipping_provider(fact: DataFrame) -> DataFrame:
    """SM8: distinct (carrier, carrier_type), null carrier dropped."""
    return fact.where(F.col("carrier").isNotNull()).select("carrier", "carrier_type").distinct()


def line_sales(lines: DataFrame) -> DataFrame:
    """Sums of customer lines by month, product and status, which add up over
    months: what the dashboard asks of lines."""
    return lines.groupBy(year_month(F.col("order_date")).alias("year_month"), "product_code", "status", "is_completed").agg(
        F.count(F.lit(1)).alias("n_lines"), *[F.sum(c).alias(c) for c in _SUMMED])


def order_sales(orders: DataFrame) -> DataFrame:
    """Sums of customer orders by month, pay method and completion."""
    return orders.groupBy(year_month(F.col("order_date")).alias("year_month"), "pay_method", "is_completed").agg(
        F.count(F.lit(1)).alias("n_orders"), *[F.sum(f"total_{c}").alias(c) for c in _SUMMED])


class Model:
    """Lazily built model tables of one folder of test data (``ExportModel``: of exports)."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = ADAPTER):
        self.spark, self.sf_dir, self.params = spark, sf_dir, params
        check_session(spark)

    @cached_property
    def items(self) -> DataFrame:
        return adapter.order_items(self.spark, self.sf_dir, self.params.max_broadcast_bytes)

    @cached_property
    def raw(self) -> DataFrame:
        """The labelled union of the shops' exports, as they come."""
        return ingest_labelled(adapter.raw_order_sources(self.spark, self.sf_dir), "shop")

    @cached_property
    def codes(self) -> DataFrame:
        return adapter.base_codes(self.spark, self.sf_dir)

    @cached_property
    def cost(self) -> DataFrame:
        p = self.params
        if p.cost_csv:
            from orderlens.sources.io import read_cost_csv

            return read_cost_csv(self.spark, p.cost_csv, p.cost_csv_code_col, p.cost_csv_cost_col)
        return adapter.cost_table(self.spark, self.sf_dir)

    @cached_property
    def cost_lookup(self) -> tuple[DataFrame, bool]:
        """Codes with a known cost, broadcast when the size check allows."""
        # a written model answers with its own costs, also without the source tables
        stored = self._stored("dim_product")
        cost = self.cost if stored is None else stored
        known = cost.where(F.col("cost").isNotNull()).select("product_code", "cost")
        return checked_broadcast(known, self.params.max_broadcast_bytes)

    @cached_property
    def cleaned(self) -> DataFrame:
        return with_completed(self.items)

    @cached_property
    def parsed(self) -> DataFrame:
        return parse_orders(self.cleaned, self.codes, self.params)

    def _stored(self, name: str) -> DataFrame | None:
        """A table of the materialised model: a bucketed catalog table when
        ``params.model_tables`` names its database, else the Parquet folder
        under ``params.model_dir``."""
        p = self.params
        if p.model_tables and name in ("fact_order_item", "dim_order"):
            return self.spark.table(f"{p.model_tables}.{name}")
        if not p.model_dir:
            return None
        return self._store.table(name)

    @cached_property
    def _store(self):
        from orderlens.operators.store import ModelStore

        return ModelStore(self.spark, self.params.model_dir, self.params)

    @cached_property
    def fact(self) -> DataFrame:
        stored = self._stored("fact_order_item")
        if stored is not None:
            return stored.select(*FACT_COLUMNS)
        return fact_order_item(self.parsed, self.params)

    @cached_property
    def dim_order(self) -> DataFrame:
        stored = self._stored("dim_order")
        if stored is not None:
            return stored.select(*DIM_ORDER_COLUMNS)
        # order-level columns only: built from the cleaned lines, so order
        # queries never plan the SKU parsing
        return dim_order(self.cleaned, self.params)

    @cached_property
    def orders(self) -> DataFrame:
        """dim_order_customer."""
        return dim_order_customer(self.dim_order)

    @cached_property
    def fact_customer(self) -> DataFrame:
        if self._stored("dim_order") is None:
            return fact_order_item_customer(self.fact, self.params)
        # the written orders know the bulk ones: no second pass over the lines
        return without_orders(self.fact, self.dim_order.where("is_bulk"))

    @cached_property
    def line_sales(self) -> DataFrame:
        stored = self._stored("line_sales")
        return line_sales(self.fact_customer) if stored is None else stored

    @cached_property
    def order_sales(self) -> DataFrame:
        stored = self._stored("order_sales")
        return order_sales(self.orders) if stored is None else stored

    @cached_property
    def dim_product(self) -> DataFrame:
        stored = self._stored("dim_product")
        return stored if stored is not None else dim_product(self.parsed, self.cost)

    @cached_property
    def dim_date(self) -> DataFrame:
        stored = self._stored("dim_date")
        return stored if stored is not None else dim_date(self.cleaned)

    @cached_property
    def dim_shipping_provider(self) -> DataFrame:
        stored = self._stored("dim_shipping_provider")
        return stored if stored is not None else dim_shipping_provider(self.fact)


class ExportModel(Model):
    """The model of real exports: raw -> cleaned -> parsed -> the same tables,
    so every query runs on it. ``exports`` maps a shop's label to its export
    (see ``checked_export``); malformed records are in ``rejects`` instead.
    ``codes`` has (code, ordinal), ``cost`` (product_code, cost). An export has
    no part number; its products are their codes."""

    def __init__(self, spark: SparkSession, exports: dict[str, str], codes: DataFrame, cost: DataFrame,
                 params: Params = DEFAULT, file_format: str = "csv", line_breaks: str = "auto"):
        super().__init__(spark, "", params if params.product_key != "part_id" else replace(params, product_key="product_code"))
        self.exports, self.file_format, self.codes, self.cost, self.line_breaks = exports, file_format, codes, cost, line_breaks

    @cached_property
    def checked(self) -> dict[str, Export]:
        return {label: checked_export(self.spark, path, label, self.file_format, line_breaks=self.line_breaks)
                for label, path in self.exports.items()}

    @cached_property
    def raw(self) -> DataFrame:
        return ingest_labelled((label, e.rows) for label, e in self.checked.items())

    @cached_property
    def rejects(self) -> DataFrame:
        """Records that are no rows: shop, file, reason, record."""
        out = self.spark.createDataFrame([], REJECTS)
        for e in self.checked.values():
            out = out.unionByName(e.rejects)
        return out

    @cached_property
    def items(self) -> DataFrame:
        return cleaned_export(self.raw, self.params)

    @cached_property
    def cleaned(self) -> DataFrame:
        return self.items


def cleaned_export(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The cleaned lines of an export with all columns that the fact needs."""
    return clean_orders(raw, params).withColumn("part_id", F.lit(None).cast("bigint"))


def materialize_stages(m: Model, base_path: str) -> dict[str, str]:
    """Write the cleaned and the parsed lines and the orders of the exports,
    overwrite-by-name; their folders by name."""
    return observed_stages(m, base_path)[0]


def observed_stages(m: Model, base_path: str) -> tuple[dict[str, str], DataFrame]:
    """``materialize_stages``, and what its writes have seen: (stage, metric,
    column_name, value). Rows of each source (IO2), values that are there (CL2),
    money and dates that do not parse (CL4, CL6), extracted SKU parts (SK5) and
    the control total of paid prices in lines and orders (SM12). They are
    observed while the rows are written: each stage is read from the one before
    it, and nothing is scanned for the report.
    """
    from orderlens.sources.io import write_table

    raw = m.raw.drop(*m.params.pii_columns)
    shops = list(getattr(m, "exports", None) or adapter.SHOP_LABELS)
    money = [c for c in {**DISCOUNT_COLUMNS, **NUMERIC_COLUMNS} if c in raw.columns]
    dates = {c: n for c, n in DATE_COLUMNS.items() if c in raw.columns}
    bad = lambda c, parsed: F.count_if(F.col(c).isNotNull() & parsed.isNull())
    paid = lambda c: F.coalesce(F.sum(c), F.lit(0))
    base, paths, report = base_path.rstrip("/"), {}, []

    def write(name: str, df: DataFrame, seen: dict[str, Observation]) -> DataFrame:
        paths[name] = write_table(df, f"{base}/{name}")
        for stage, observation in seen.items():
            report.extend((stage, *key.split("|"), int(value)) for key, value in observation.get.items())
        return m.spark.read.schema(df.schema).parquet(paths[name])

    def observed(df: DataFrame, observation: Observation, metrics: dict[str, Column]) -> DataFrame:
        return df.observe(observation, *[c.alias(key) for key, c in metrics.items()])

    as_read, clean, parsed, orders = (Observation() for _ in range(4))
    raw = observed(raw, as_read, {
        **{f"rows|{shop}": F.count_if(F.col("shop") == shop) for shop in shops},
        **{f"values|{c}": F.count(F.col(c)) for c in raw.columns},
        **{f"unparsed|{c}": bad(c, whole_units(F.col(c))) for c in money},
    })
    lines = observed(cleaned_export(raw, m.params), clean, {
        **{f"unparsed|{c}": bad(c, F.col(n)) for c, n in dates.items()}, "total|paid_price": paid("paid_price")})
    lines = write("orders_clean", lines, {"raw": as_read, "clean": clean})
    sku = ("product_code", "campaign_flag", "promo_label")
    lines = observed(parse_orders(lines, m.codes, m.params), parsed, {
        **{f"values|{c}": F.count(F.col(c)) for c in sku}, "values|has_gift": F.count_if("has_gift"), "total|paid_price": paid("paid_price")})
    lines = write("orders_parsed", lines, {"parsed": parsed})
    by_order = observed(dim_order(lines, m.params), orders, {"rows|orders": F.count(F.lit(1)), "total|paid_price": paid("total_paid_price")})
    write("orders", by_order, {"orders": orders})
    return paths, m.spark.createDataFrame(report, "stage string, metric string, column_name string, value long")


MODEL_TABLES = ("fact_order_item", "dim_order", "dim_product", "dim_date", "dim_shipping_provider")


def materialize_model(m: Model, base_path: str, buckets: int = 0, database: str | None = None) -> dict[str, str]:
    """IO6: write the model under ``base_path`` (a shared folder) as a new
    version of its store (see ``store.ModelStore``: readers see the old tables or
    the new ones; the fact is partitioned by month, so date filters prune
    folders). Returns each table's folder.

    With ``buckets`` and ``database``, the fact and the order dimension are also
    written as catalog tables bucketed and sorted by order number: analyses
    reading them with ``Params(model_dir=base_path, model_tables=database)``
    join lines to orders without a shuffle. These two are replaced in place.
    """
    from orderlens.operators.store import ModelStore

    store = ModelStore(m.spark, base_path, m.params)
    store.build(m.parsed, m.cost)
    out = {name: path for name, path in store.paths().items() if name in MODEL_TABLES}
    if buckets and database:
        base = base_path.rstrip("/")
        m.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{base}/_catalog'")
        for name, columns in (("fact_order_item", FACT_COLUMNS), ("dim_order", DIM_ORDER_COLUMNS)):
            (store.table(name).select(*columns).write.mode("overwrite").option("path", f"{base}/_bucketed/{name}")
             .bucketBy(buckets, "order_number").sortBy("order_number").saveAsTable(f"{database}.{name}"))
            out[name] = f"{database}.{name}"
    return out
