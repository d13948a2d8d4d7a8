"""The written model: whole or not at all, and refreshed month by month."""

import datetime as dt
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orderlens.config import ADAPTER
from orderlens.operators import store as st
from orderlens.operators.model import DIM_ORDER_COLUMNS, FACT_COLUMNS, MODEL_TABLES, Model
from orderlens.plans import registry

from conftest import SF_SMALL

COLUMNS = {"fact_order_item": FACT_COLUMNS, "dim_order": DIM_ORDER_COLUMNS}


def rows(df, name=""):
    return sorted(map(tuple, df.select(*COLUMNS.get(name, sorted(df.columns))).collect()), key=str)


def same(a, b):
    for name in (*MODEL_TABLES, "line_sales", "order_sales"):
        assert rows(a.table(name), name) == rows(b.table(name), name), name


@pytest.fixture(scope="module")
def model(spark):
    return Model(spark, SF_SMALL)


@pytest.fixture(scope="module")
def lines(spark, model):
    """Parsed lines of 18 months, written once for this module, with lines that
    lack an order key or a date, and orders whose lines lie in several months."""
    path = tempfile.mkdtemp(prefix="orderlens-store-lines-") + "/lines"
    later = F.when((F.col("order_number") % 5 == 0) & (F.col("line_number") > 2), F.col("created_at") + F.expr("INTERVAL 40 DAYS"))
    odd = model.parsed.where(F.col("created_at") < dt.datetime(1996, 7, 1)).withColumn("created_at", F.coalesce(later, "created_at"))
    odd = odd.withColumn("created_at", F.when((F.col("order_number") % 50 == 1) & (F.col("line_number") == 2), F.lit(None)).otherwise(F.col("created_at")))
    odd = odd.withColumn("order_number", F.when(F.col("order_number") % 70 == 3, F.lit(None)).otherwise(F.col("order_number")))
    odd.write.parquet(path)
    return spark.read.schema(odd.schema).parquet(path)


@pytest.fixture(scope="module")
def whole(spark, model, lines):
    out = new(spark)
    out.build(lines, model.cost)
    return out


def new(spark):
    return st.ModelStore(spark, tempfile.mkdtemp(prefix="orderlens-store-"), ADAPTER)


CUT = dt.datetime(1996, 6, 1)


def test_build_equals_the_derived_tables(spark, model):
    out = new(spark)
    assert out.version() is None
    assert out.build(model.parsed, model.cost) == 1
    for name in MODEL_TABLES:
        assert rows(out.table(name), name) == rows(getattr(model, {"fact_order_item": "fact"}.get(name, name)), name), name
    assert rows(out.row_counts()) == rows(registry.QUERY_KEYS["model_row_counts"](model))


@pytest.mark.parametrize("late", ["by date", "lines of old orders", "orders without a key"])
def test_append_equals_full_build(spark, model, lines, whole, late):
    """New months, more lines of orders in many months, and the order of null keys."""
    new_line = {"by date": F.coalesce(F.col("created_at") >= CUT, F.lit(True)),
                "lines of old orders": (F.col("line_number") == 3) & (F.coalesce("order_number", F.lit(0)) % 3 == 0),
                "orders without a key": F.col("order_number").isNull() & (F.col("line_number") > 1)}[late]
    out = new(spark)
    out.build(lines.where(~new_line), model.cost)
    before = out._tables(out._newest())
    assert out.refresh(lines.where(new_line), model.cost) == 2
    same(out, whole)
    assert rows(out.row_counts()) == rows(whole.row_counts())
    if late == "by date":  # the old months' folders are named again, and only a month's own folders are read
        after = out._tables(out._newest())
        old = {p for p in before["fact_order_item"]["parts"]}
        assert old <= set(after["fact_order_item"]["parts"])
        untouched = {p.month for p in after["dim_order"]["parts"] if p.version.startswith("1-")}
        assert len(untouched) > 2


def test_replaced_orders_equal_full_build(spark, model, lines, whole, monkeypatch):
    """Orders delivered again with other states and dates; months outside are neither read nor written."""
    again = F.col("order_number").isNotNull() & (F.col("created_at") >= CUT)
    orders = lines.where(again).select("order_number", "shop").distinct()
    late = lines.join(orders, ["order_number", "shop"], "left_semi").select(*lines.columns)
    stale = late.withColumn("status", F.lit("packed")).withColumn("is_completed", F.lit(False)).withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 20 DAYS"))
    out = new(spark)
    out.build(lines.join(orders, ["order_number", "shop"], "left_anti").select(*lines.columns).unionByName(stale), model.cost)
    read = []
    reader = out._read
    monkeypatch.setattr(out, "_read", lambda name, table, months=None: read.append((name, reader(name, table, months))) or read[-1][1])
    out.refresh(late, model.cost, "replace")
    files = [f for name, df in read if name == "fact_order_item" for f in df.inputFiles()]
    months = {f.split("order_month=")[1].split("/")[0] for f in files}
    assert files and min(m for m in months if m != st.UNDATED) >= "1996-03"
    kept = {p.month for p in out._tables(out._newest())["fact_order_item"]["parts"] if p.version.startswith("1-")}
    assert len(kept) > 10 and not kept & months
    same(out, whole)


def test_failed_write_leaves_the_old_model(spark, model, lines, whole):
    out = new(spark)
    out.build(lines.where("line_number < 3"), model.cost)
    old = {name: rows(out.table(name), name) for name in MODEL_TABLES}
    broken = lines.withColumn("unit_price", F.when(F.col("line_number") == 4, F.raise_error(F.lit("broken line")).cast("bigint")).otherwise(F.col("unit_price")))
    for write in (lambda: out.build(broken, model.cost), lambda: out.refresh(broken, model.cost), lambda: out.refresh(lines, model.cost.withColumn("cost", F.raise_error(F.lit("no cost")).cast("bigint")))):
        with pytest.raises(Exception, match="broken line|no cost"):
            write()
        assert out.version() == 1 and {name: rows(out.table(name), name) for name in MODEL_TABLES} == old
    # a job may read the model that it replaces, and goes on from there
    reader = Model(spark, "/nowhere", replace(ADAPTER, model_dir=out.base))
    frame = reader.dim_order
    out.build(lines, model.cost)
    assert rows(frame, "dim_order") == old["dim_order"]
    same(out, whole)
    assert out.expire(keep=2) and rows(frame, "dim_order") == old["dim_order"]  # folders of the failed writes
    assert out.expire(keep=1)
    same(out, whole)


def test_second_writer_is_refused(spark, model, lines, monkeypatch):
    out = new(spark)
    few = lines.where("line_number = 1")
    out.build(few, model.cost)
    other = st.ModelStore(spark, out.base, ADAPTER)
    commit = out._commit
    monkeypatch.setattr(out, "_commit", lambda *a: other.refresh(few, model.cost) and commit(*a))
    with pytest.raises(st.ConcurrentRefresh):
        out.refresh(few, model.cost)
    assert out.version() == 2 and out.table("fact_order_item").count() == 2 * few.count()


def test_many_appends_are_folded(spark, model, lines, monkeypatch):
    monkeypatch.setattr(st, "MAX_FOLDERS", 2)
    out = new(spark)
    part = lambda k: lines.where((F.col("line_number") % 4 == k) & (F.col("created_at") < dt.datetime(1995, 6, 1)))
    out.build(part(0), model.cost)
    for k in (1, 2, 3):
        out.refresh(part(k), model.cost)
    full = new(spark)
    full.build(lines.where(F.col("created_at") < dt.datetime(1995, 6, 1)), model.cost)
    same(out, full)
    folders = [p.month for p in out._tables(out._newest())["fact_order_item"]["parts"]]
    assert max(map(folders.count, folders)) <= 2


def test_empty_model(spark, model, lines):
    out = new(spark)
    out.build(lines.limit(0), model.cost)
    assert all(out.table(n).count() == 0 for n in MODEL_TABLES)
    out.refresh(lines.where("line_number = 1"), model.cost)
    assert out.table("fact_order_item").count() == lines.where("line_number = 1").count()


def test_dashboard_from_stored_sums(spark, model):
    """The dashboard's keys over a written model read its sums, not its lines, and give the same."""
    out = new(spark)
    out.build(model.parsed, model.cost)
    stored = Model(spark, "/nowhere", replace(ADAPTER, model_dir=out.base))
    for key in ("biz_monthly", "revenue_bridge", "pareto_revenue", "rank_revenue_vs_profit", "cancel_rate_by_product", "status_mix_by_month", "cancel_rate_by_pay_method"):
        got = registry.QUERY_KEYS[key](stored)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "fact_order_item" not in plan and f"{out.base}/dim_order/" not in plan, key
        assert rows(got) == rows(registry.QUERY_KEYS[key](model)), key


def test_large_tables_are_written_by_groups_of_months(spark, model, lines, whole, monkeypatch, tmp_path):
    """Some months at a time; nothing is left in the scratch folder, also for a table without rows."""
    monkeypatch.setattr(st, "GROUP_BYTES", 1)
    monkeypatch.setattr(st, "GROUPS", 4)
    monkeypatch.setattr(st, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    seen = []
    groups = st.ModelStore._groups

    def counted(self, df):
        for rows in groups(self, df):
            seen.append({r[0] for r in rows.select(st.MONTH).distinct().collect()})
            yield rows

    monkeypatch.setattr(st.ModelStore, "_groups", counted)
    out = new(spark)
    out.build(lines.where(F.col("created_at") < CUT), model.cost)
    fact = seen[: len(seen) // 2]
    assert len(fact) > 2 and sum(map(len, fact)) == len(set.union(*fact))
    out.refresh(lines.where(F.coalesce(F.col("created_at") >= CUT, F.lit(True))), model.cost)
    same(out, whole)
    assert not list(tmp_path.iterdir())
    none = new(spark)
    none.build(lines.limit(0), model.cost)
    assert rows(none.table("fact_order_item")) == [] == rows(none.table("dim_order"))


def test_lines_of_chosen_orders_need_no_other_shuffle(spark, model):
    from orderlens.plans.model_tables import _of_orders

    odd = spark.createDataFrame([(1, "a", 1), (1, "a", 0), (1, "b", 0), (2, None, 1), (None, "a", 1), (3, "a", 0), (4, "b", 1), (4, "b", 1)],
                                "order_number long, shop string, n int")
    assert rows(_of_orders(odd, F.col("n") == 1)) == sorted([(1, 1, "a"), (0, 1, "a"), (1, 4, "b"), (1, 4, "b")], key=str)
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "true")
        df = _of_orders(model.cleaned, F.col("created_at") >= CUT)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4, plan  # lines and orders, twice
    finally:
        spark.conf.set(name, before)
