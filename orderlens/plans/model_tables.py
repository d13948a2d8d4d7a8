"""Star-schema tables and their checks as queries (SM1-SM14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.model import DIM_ORDER_COLUMNS, FACT_COLUMNS, ORDER_KEY, Model, cleaned_export, parse_orders
from orderlens.operators.model import fact_order_item as fact_of
from orderlens.operators.store import ModelStore
from orderlens.session import scratch_path


def fact_order_item(m: Model) -> DataFrame:
    """SM1: one row per order line with parsed SKU attributes and the carrier spelling fixed."""
    return m.fact


def fact_from_exports(m: Model) -> DataFrame:
    """SM1 from the raw exports: union -> cleaning -> SKU parsing -> fact."""
    return fact_of(parse_orders(cleaned_export(m.raw, m.params), m.codes, m.params), m.params)


def dim_order(m: Model) -> DataFrame:
    """SM2 + SM3: one row per (order_number, shop) with the bulk flag."""
    return m.dim_order


def dim_order_customer(m: Model) -> DataFrame:
    """SM4: the order dimension without bulk orders."""
    return m.orders


def fact_order_item_customer(m: Model) -> DataFrame:
    """SM5: fact lines of the orders that survive the bulk exclusion."""
    return m.fact_customer


def dim_product(m: Model) -> DataFrame:
    """SM6: product codes in use with their cost (null when unknown)."""
    return m.dim_product


def dim_date(m: Model) -> DataFrame:
    """SM7: dense daily calendar of the data range."""
    return m.dim_date


def dim_shipping_provider(m: Model) -> DataFrame:
    """SM8: distinct (carrier, carrier type)."""
    return m.dim_shipping_provider


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")


def model_row_counts(m: Model) -> DataFrame:
    """SM9: rows of every model table."""
    parts = [
        _count(m.fact, "fact_order_item"),
        _count(m.dim_order, "dim_order"),
        _count(m.dim_product, "dim_product"),
        _count(m.dim_date, "dim_date"),
        _count(m.dim_shipping_provider, "dim_shipping_provider"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _late(m: Model):
    """The last 60 days of the data."""
    return F.col("created_at") >= m.cleaned.agg(F.max("created_at").alias("t")).first()["t"] - F.expr("INTERVAL 60 DAYS")


def _refreshed(m: Model) -> ModelStore:
    """A store of all lines but the last days', refreshed with these."""
    store, late = ModelStore(m.spark, scratch_path(m.spark, "model-store"), m.params), F.coalesce(_late(m), F.lit(False))
    store.build(m.parsed.where(~late), m.cost)
    store.refresh(m.parsed.where(late), m.cost)
    return store


def store_row_counts(m: Model) -> DataFrame:
    """IO6 + SM9: rows of every table of a refreshed model, as its writes counted them."""
    return _refreshed(m).row_counts()


def refreshed_dim_order(m: Model) -> DataFrame:
    """IO6 + SM2: the order dimension after an incremental refresh."""
    return _refreshed(m).table("dim_order").select(*DIM_ORDER_COLUMNS)


def _of_orders(lines: DataFrame, chosen) -> DataFrame:
    """All lines of the orders that have a chosen line. They meet by the order number
    alone, by which the lines are dealt already, so that they need no other shuffle."""
    order, shop = ORDER_KEY
    orders = lines.where(chosen).groupBy(F.col(order).alias("_number")).agg(F.collect_set(shop).alias("_shops"))
    return lines.join(orders, (F.col(order) == F.col("_number")) & F.array_contains("_shops", F.col(shop)), "left_semi")


def replaced_fact(m: Model) -> DataFrame:
    """IO6 + SM1: the fact after the orders of the last days, first written with
    an earlier state, were delivered again."""
    store, late = ModelStore(m.spark, scratch_path(m.spark, "model-store"), m.params), F.coalesce(_late(m), F.lit(False))
    # only the lines of these orders are parsed again
    again = parse_orders(_of_orders(m.cleaned, late), m.codes, m.params).select(*m.parsed.columns)
    stale = {"status": F.when(late, F.lit("packed")).otherwise(F.col("status")), "is_completed": ~late & F.col("is_completed")}
    store.build(m.parsed.withColumns(stale), m.cost)
    store.refresh(again, m.cost, "replace")
    return store.table("fact_order_item").select(*FACT_COLUMNS)


def _dup_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    dups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dups.agg(F.count(F.lit(1)).alias("n_duplicate_keys")).select(
        F.lit(name).alias("key_name"), "n_duplicate_keys"
    )


def model_key_checks(m: Model) -> DataFrame:
    """SM10 (+T22): number of key values that occur more than once."""
    parts = [
        _dup_keys(m.fact, ["order_number", "line_number"], "fact_order_item.item_key"),
        _dup_keys(m.dim_order, ORDER_KEY, "dim_order.order_key"),
        _dup_keys(m.dim_product, ["product_code"], "dim_product.product_code"),
        _dup_keys(m.dim_shipping_provider, ["carrier"], "dim_shipping_provider.carrier"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def products_without_cost(m: Model) -> DataFrame:
    """SM11."""
    return m.dim_product.agg(F.count_if(F.col("cost").isNull()).alias("n_products_without_cost"))


def reconcile_paid_total(m: Model) -> DataFrame:
    """SM12: control total of paid price, fact vs order dimension."""
    fact_total = m.fact.select(F.sum("paid_price")).scalar()
    dim_total = m.dim_order.select(F.sum("total_paid_price")).scalar()
    return m.spark.range(1).select(
        fact_total.alias("total_fact"),
        dim_total.alias("total_dim"),
        (fact_total == dim_total).alias("is_match"),
    )


def bulk_exclusion_impact(m: Model) -> DataFrame:
    """SM13: headline order metrics before and after removing bulk orders,
    one pass over the order dimension with conditional aggregates."""
    o = m.dim_order
    bad = ~F.col("is_completed")
    keep = ~F.col("is_bulk")
    one = o.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(keep).alias("n_after"),
        F.count_if(bad).alias("bad_before"),
        F.count_if(bad & keep).alias("bad_after"),
        F.sum(F.when(bad, F.col("total_unit_price"))).alias("lost_before"),
        F.sum(F.when(bad & keep, F.col("total_unit_price"))).alias("lost_after"),
    )
    return one.select(
        F.explode(
            F.array(
                F.struct(F.lit("n_orders").alias("metric"), F.col("n_before").cast("double").alias("before"),
                         F.col("n_after").cast("double").alias("after")),
                F.struct(F.lit("pct_incomplete").alias("metric"),
                         F.try_divide(F.lit(100.0) * F.col("bad_before"), F.col("n_before")).alias("before"),
                         F.try_divide(F.lit(100.0) * F.col("bad_after"), F.col("n_after")).alias("after")),
                F.struct(F.lit("lost_revenue").alias("metric"), F.col("lost_before").cast("double").alias("before"),
                         F.col("lost_after").cast("double").alias("after")),
            )
        ).alias("r")
    ).select("r.metric", "r.before", "r.after")


def bulk_lost_share(m: Model) -> DataFrame:
    """SM14: share of all lost revenue (list value of incomplete orders) that
    comes from bulk orders."""
    bad = ~F.col("is_completed")
    one = m.dim_order.agg(
        F.sum(F.when(bad, F.col("total_unit_price"))).alias("lost_total"),
        F.sum(F.when(bad & F.col("is_bulk"), F.col("total_unit_price"))).alias("lost_bulk"),
        F.count_if(F.col("is_bulk")).alias("n_bulk_orders"),
        F.count_if(F.col("is_bulk") & bad).alias("n_bulk_incomplete"),
    )
    return one.withColumn("pct_bulk", F.try_divide(F.lit(100.0) * F.col("lost_bulk"), F.col("lost_total")))
