"""Physical-plan properties of every query (shape, not timing)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderlens.sources.adapter import RAW_COLUMNS, raw_order_sources
from orderlens.sources.io import ingest_labelled

from conftest import SF_SMALL

QUERIES = entry.core_queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # built-in expressions only: no Python UDF or Python evaluation node
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan, node


def test_personal_columns_never_read(spark):
    for key in ("clean_drop_columns", "clean_money", "status_distribution", "ingest_union_labelled"):
        plan = _plan(QUERIES[key](spark, SF_SMALL))
        assert "c_name" not in plan and "c_mktsegment" not in plan, key
        assert "customer.parquet" not in plan, key  # the whole personal-data join is pruned


def test_raw_columns_constant_matches_union(spark):
    raw = ingest_labelled(raw_order_sources(spark, SF_SMALL)).drop("customer_name", "customer_segment")
    assert sorted(raw.columns) == sorted(RAW_COLUMNS)


def test_customer_anti_join_reuses_order_partitioning(spark):
    # the lines are shuffled by order key once per branch; the (order, shop)
    # anti-join on bulk orders and the count per order add no exchange of their own
    plan = _plan(QUERIES["fact_order_item_customer"](spark, "/root/testdata/sf0.1"))
    assert "LeftAnti" in plan
    assert plan.count("hashpartitioning(l_orderkey") == 2
    assert "hashpartitioning(order_number" not in plan


def test_orders_join_is_a_shuffle_join(spark):
    plan = _plan(QUERIES["dim_order"](spark, "/root/testdata/sf0.1"))
    assert "SortMergeJoin" in plan
    # the numeric measures are hash-aggregated by (order, shop, pay method);
    # only the string max runs sort-based, over the collapsed rows
    first_level = [ln for ln in plan.splitlines() if "keys=[order_number" in ln and "pay_method" in ln.split("functions")[0]]
    assert first_level and all("HashAggregate" in ln for ln in first_level)


def test_code_index_is_built_once_and_only_if_read(spark):
    df = QUERIES["sku_product_code"](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    assert len(set(re.findall(r"ReusedSubquery Subquery subquery#(\d+)", plan))) == 1
    assert "subquery#" not in _plan(QUERIES["delivery_days_by_carrier"](spark, SF_SMALL))


def test_filters_on_the_code_look_it_up_once_each(spark):
    """A join or filter on the code is moved below the lookup, and so writes the
    lookup out again: its steps must not be written into each other on the way."""
    from orderlens.operators.prefix_match import with_product_code

    codes = spark.createDataFrame([(f"A{'B' * (i % 5)}{i}", i) for i in range(40)], "code string, ordinal int")
    skus = spark.range(0, 400).select(F.concat(F.lit("abbb"), F.col("id").cast("string")).alias("seller_sku"))
    cost = codes.select(F.col("code").alias("product_code"), "ordinal")
    coded = lambda how: with_product_code(skus, codes, strategy=how).join(cost, "product_code").where(F.length("product_code") > 2)
    out = coded("broadcast")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("transform(array(struct(keys") <= 4, plan[:2000]  # two conditions, the column
    # no row holds the index
    assert " AS _pm_one#" not in plan, plan[:2000]
    for name in ("fact_order_item", "sku_coverage", "item_margin", "sku_unmatched", "fact_from_exports"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(array(struct(keys" in plan and " AS _pm_one#" not in plan, name
    assert sorted(out.collect()) == sorted(coded("distinct").collect()) != []


def test_replaced_orders_are_chosen_before_their_lines_are_parsed(spark, monkeypatch):
    from orderlens.operators.model import fact_order_item
    from orderlens.operators.store import ModelStore

    seen = []
    monkeypatch.setattr(ModelStore, "build", lambda self, parsed, cost: 1)
    monkeypatch.setattr(ModelStore, "refresh", lambda self, parsed, cost, mode: seen.append(parsed))
    monkeypatch.setattr(ModelStore, "table", lambda self, name: fact_order_item(seen[0]))
    QUERIES["replaced_fact"](spark, SF_SMALL)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("transform(array(struct(keys") < plan.index("Join LeftSemi"), plan[:3000]


def test_checkpoint_calls_ensure_a_folder():
    # every module that checkpoints makes sure a checkpoint folder exists first
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "orderlens"
    for p in root.rglob("*.py"):
        src = p.read_text()
        if ".checkpoint(eager=True)" in src:
            assert "ensure_checkpoint_dir(" in src, p


def test_every_query_is_documented():
    from orderlens.plans import registry

    assert all((f.__doc__ or "").strip() for f in registry.QUERY_KEYS.values())
