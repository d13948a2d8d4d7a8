"""CSV source and sink (IO4, IO5)."""

import datetime as dt
import os
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orderlens.sources.io import export_csv, read_cost_csv, read_exported_csv


def test_cost_csv_with_bom_and_quoted_commas(spark):
    path = tempfile.mkdtemp(prefix="orderlens-csv-") + "/cost.csv"
    text = ('﻿code,name,unit_cost,note\n"AB,1","a, b",36000,\nCT,c,660,x\n'
            '"CT ""x""",d,137500,\nZZ,e,,\n')
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    rows = {r.product_code: r.cost for r in read_cost_csv(spark, path, "code", "unit_cost").collect()}
    assert rows == {"AB,1": 36000, "CT": 660, 'CT "x"': 137500, "ZZ": None}


def test_model_reads_cost_csv(spark):
    from orderlens.config import ADAPTER
    from orderlens.operators.model import Model

    from conftest import SF_SMALL

    path = tempfile.mkdtemp(prefix="orderlens-csv-") + "/cost.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("product_code,cost\nBrand#10,1000\n")
    m = Model(spark, SF_SMALL, replace(ADAPTER, cost_csv=path))
    got = {r.product_code: r.cost for r in m.dim_product.collect()}
    assert got["Brand#10"] == 1000 and got["Brand#11"] is None


def test_export_csv_roundtrip(spark):
    values = ["a,b", None, "", " lead", "trail ", 'say "x"', "two\nlines", "tab\t", "\\", "'", "ünïcode", '""', "#c"]
    rows = [(i, v, dt.datetime(2024, 1, 2, 3, 4, 5, 123456) if i % 2 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, s string, at timestamp_ntz")
    path = tempfile.mkdtemp(prefix="orderlens-csv-out-") + "/out"
    export_csv(df, path)
    back = read_exported_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == rows


def test_scratch_export_is_compressed_in_bounded_files(spark, monkeypatch):
    from orderlens.sources import io

    monkeypatch.setitem(io.SCRATCH_CSV, "maxRecordsPerFile", 300)
    folders = []
    monkeypatch.setattr(io, "scratch_path", lambda *_: folders.append(tempfile.mkdtemp(prefix="orderlens-csv-out-") + "/out") or folders[-1])
    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, concat('order, ', id % 9)) AS s", "if(id = 5, 'two\nlines', '') AS t")
    back = io.export_csv_roundtrip(spark, df.coalesce(1))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files = [f for f in os.listdir(folders[0]) if f.startswith("part-")]
    assert len(files) == 4 and all(f.endswith(".csv.gz") for f in files)
    plain = export_csv(df, tempfile.mkdtemp(prefix="orderlens-csv-out-") + "/out")
    size = lambda folder: sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-"))
    assert size(folders[0]) < size(plain) / 2


def test_materialize_model_roundtrip(spark):
    from orderlens.operators.model import MODEL_TABLES, Model, materialize_model

    from conftest import SF_SMALL

    m = Model(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="orderlens-model-")
    paths = materialize_model(m, base)
    assert set(paths) == set(MODEL_TABLES)
    fact = spark.read.parquet(paths["fact_order_item"])
    assert fact.count() == m.fact.count()
    assert "order_month" in fact.columns
    assert spark.read.parquet(paths["dim_order"]).count() == m.dim_order.count()


def test_queries_on_materialised_model_match(spark):
    """Analyses read the written model tables and give the same results."""
    from orderlens.config import ADAPTER
    from orderlens.operators.model import Model, materialize_model
    from orderlens.plans import registry

    from conftest import SF_SMALL

    base = tempfile.mkdtemp(prefix="orderlens-model-q-")
    materialize_model(Model(spark, SF_SMALL), base)
    stored = replace(ADAPTER, model_dir=base)
    keys = ["incomplete_by_month", "incomplete_by_reason", "campaign_margin_pooled", "cod_vs_prepaid",
            "rfm_segment_summary", "cohort_retention", "pareto_revenue", "model_row_counts", "dim_order_customer"]
    for k in keys:
        fn = registry.QUERY_KEYS[k]
        a = sorted(map(tuple, fn(Model(spark, SF_SMALL)).collect()), key=str)
        b = sorted(map(tuple, fn(Model(spark, SF_SMALL, stored)).collect()), key=str)
        assert a == b, k


def test_written_model_is_read_once_and_has_its_own_costs(spark):
    from orderlens.config import ADAPTER
    from orderlens.operators.model import Model, materialize_model
    from orderlens.plans import registry

    from conftest import SF_SMALL

    base = tempfile.mkdtemp(prefix="orderlens-model-once-")
    cost = tempfile.mkdtemp(prefix="orderlens-cost-") + "/cost.csv"
    with open(cost, "w") as f:
        f.write("product_code,cost\nBrand#10,123\n")
    materialize_model(Model(spark, SF_SMALL, replace(ADAPTER, cost_csv=cost)), base)
    m = Model(spark, "/nowhere", replace(ADAPTER, model_dir=base))  # no source tables at all
    assert {(r.product_code, r.cost) for r in registry.QUERY_KEYS["item_margin"](m).select("product_code", "cost").distinct().collect()} == {("Brand#10", 123)}
    for k in ("incomplete_by_reason", "unpaid_by_pay_method", "campaign_rate_on_double_dates", "campaign_margin_pooled",
              "campaign_rate_baseline"):
        plan = registry.QUERY_KEYS[k](m)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{base}/fact_order_item") == 1, k
    for k in ("daily_orders_dense", "campaign_offset_profile", "campaign_day_summary", "pre_holiday_summary", "campaign_weekday_mix"):
        plan = registry.QUERY_KEYS[k](m)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{base}/fact_order_item") == 0 and plan.count(f"{base}/dim_order") == 1, k


def test_model_of_exports(spark):
    """The raw lines as two shops' CSV exports with the export's own headers."""
    from orderlens.config import ADAPTER, EXPORT_COLUMNS
    from orderlens.operators.model import ExportModel, Model, observed_stages
    from orderlens.plans import registry
    from orderlens.sources.io import CSV_OPTIONS

    from conftest import SF_SMALL

    base = tempfile.mkdtemp(prefix="orderlens-exports-")
    own = Model(spark, SF_SMALL)
    exports = {}
    for shop in ("shop_a", "shop_b"):
        exports[shop] = f"{base}/{shop}"
        raw = own.raw.where(F.col("shop") == shop).withColumn("customerName", F.lit("someone"))
        raw = raw.select("customerName", *[F.col(name).alias(c) for c, name in EXPORT_COLUMNS.items()])
        raw.write.options(**CSV_OPTIONS, emptyValue='""').csv(exports[shop])
    m = ExportModel(spark, exports, own.codes, own.cost, ADAPTER)
    assert m.params.product_key == "product_code" and "customerName" not in m.raw.columns

    def rows(df):
        return sorted((tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect()))

    assert rows(m.fact) == rows(registry.QUERY_KEYS["fact_from_exports"](own))
    for k in ("incomplete_by_month", "campaign_margin_pooled", "cohort_sizes", "rfm_segments", "daily_orders_dense", "parse_failure_counts", "case_variant_report"):
        assert registry.QUERY_KEYS[k](m).count() > 0, k
    stages, report = observed_stages(m, f"{base}/stages")
    seen = {(r.stage, r.metric, r.column_name): r.value for r in report.collect()}
    assert seen["raw", "rows", "shop_a"] + seen["raw", "rows", "shop_b"] == own.raw.count()
    assert seen["clean", "total", "paid_price"] == seen["orders", "total", "paid_price"] == spark.read.parquet(stages["orders"]).agg(F.sum("total_paid_price")).first()[0]
    assert {"created_at", "item_name"} <= set(spark.read.parquet(stages["orders_clean"]).columns)
    parsed = spark.read.parquet(stages["orders_parsed"])
    assert parsed.count() == m.raw.count() and "item_name" not in parsed.columns
    renamed = spark.read.option("header", True).csv(exports["shop_a"]).withColumnRenamed("unitPrice", "price")
    renamed.write.option("header", True).csv(f"{base}/renamed")
    with pytest.raises(ValueError, match="unitPrice"):
        ExportModel(spark, {"shop_a": f"{base}/renamed"}, own.codes, own.cost, ADAPTER).raw


def test_session_settings_are_checked(spark):
    from orderlens.session import check_session

    assert check_session(spark) == []
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        assert len(check_session(spark)) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_broadcast_bound_is_in_bytes(spark):
    from orderlens.operators.joins import checked_broadcast

    narrow = spark.range(1000)
    wide = narrow.selectExpr("id", "repeat('x', 2000) AS text")
    assert checked_broadcast(narrow, 1 << 20)[1] and not checked_broadcast(wide, 1 << 20)[1]
    assert checked_broadcast(wide, 4 << 20)[1] and not checked_broadcast(narrow, 1000)[1]
    assert checked_broadcast(narrow.limit(0), 0)[1]


def test_bucketed_model_joins_without_shuffle(spark):
    from orderlens.config import ADAPTER
    from orderlens.operators.model import Model, materialize_model
    from orderlens.plans import registry

    from conftest import SF_SMALL

    base = tempfile.mkdtemp(prefix="orderlens-bucketed-")
    materialize_model(Model(spark, SF_SMALL), base, buckets=4, database="orderlens_test")
    p = replace(ADAPTER, model_dir=base, model_tables="orderlens_test")
    # as at scale, where the order table is far too big to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = Model(spark, SF_SMALL, p)
        plan = m.fact_customer._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "hashpartitioning" not in plan  # bucketed by order number on both sides: no shuffle
    fn = registry.QUERY_KEYS["incomplete_by_reason"]
    a = sorted(map(tuple, fn(Model(spark, SF_SMALL)).collect()), key=str)
    b = sorted(map(tuple, fn(Model(spark, SF_SMALL, p)).collect()), key=str)
    assert a == b


HEADER = "orderNumber,sku,note"


def write_files(base, *texts):
    import os

    os.makedirs(base)
    for k, text in enumerate(texts):
        with open(f"{base}/part-{k}.csv", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return base


def test_malformed_lines_are_set_aside(spark):
    from orderlens.sources.exports import read_csv_checked, reject_counts

    base = tempfile.mkdtemp(prefix="orderlens-rejects-")
    lines = ["1,a,x", '2,"b,c","say ""hi"""', "3,too,many,fields", "4,few", '5,"open,x', "6,,", " 7 , d ,  ", "8,é,ü"]
    path = write_files(f"{base}/a", "\ufeff" + "\r\n".join([HEADER, *lines[:4]]) + "\r\n", "\n".join([HEADER, *lines[4:]]) + "\n\n")
    rows, rejects = read_csv_checked(spark, path, "a", "reject")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("1", "a", "x"), ("2", "b,c", 'say "hi"'), ("6", None, None), (" 7 ", " d ", "  "), ("8", "é", "ü")], key=str)
    assert {(r.shop, r.reason, r.record) for r in rejects.collect()} == {("a", "number of fields", "3,too,many,fields"), ("a", "number of fields", "4,few"), ("a", "open quote", '5,"open,x')}
    assert all(r.file.endswith(".csv") for r in rejects.collect())
    assert rows.select("sku").count() == 5 and rejects.select("record").count() == 3  # whatever columns are read
    counts = reject_counts(rows.withColumn("shop", F.lit("a")), rejects).collect()
    assert [tuple(r) for r in counts] == [("a", 5, 2, 1)]


def test_line_breaks_in_fields_and_splits(spark):
    from orderlens.sources.exports import has_line_breaks, read_csv_checked

    base = tempfile.mkdtemp(prefix="orderlens-breaks-")
    broken = write_files(f"{base}/b", f'{HEADER}\n1,a,"two\nlines"\n2,b,c\n3,x\n')
    assert has_line_breaks(spark, broken)
    rows, rejects = read_csv_checked(spark, broken, "b")
    assert sorted(map(tuple, rows.collect())) == [("1", "a", "two\nlines"), ("2", "b", "c")]
    assert [(r.reason, r.record.strip()) for r in rejects.collect()] == [("number of fields", "3,x")]
    large = write_files(f"{base}/c", HEADER + "\n" + "".join(f"{i},sku{i},{'n' * 50}\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows, rejects = read_csv_checked(spark, large, "c")
        assert rows.rdd.getNumPartitions() >= 3 and rows.count() == 60_000 and rejects.count() == 0  # one file, several tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    empty = write_files(f"{base}/d", HEADER + "\n")
    assert [read_csv_checked(spark, empty, "d")[k].count() for k in (0, 1)] == [0, 0]


def test_lines_of_an_export_are_parsed_once_a_table(spark, tmp_path):
    """Neither the header's check nor the cleaning of a line's ends is written out
    for every column of the export."""
    from orderlens.sources.exports import _lines, read_csv_checked

    names = [f"c{i}" for i in range(12)]
    good, head = ",".join("x" * 12), ",".join(names)
    lines = [head, good, head, head + ",more", good + ",y", '"' + good, good.replace("x", "c0"), good[:-2], "\ufeff" + good, "", '"c0",' + head[3:]]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    found = read_csv_checked(spark, str(tmp_path), "s", "reject")
    assert sorted(r.c0 for r in found.rows.collect()) == ["c0", "x", "x"]
    assert sorted((r.reason, r.record) for r in found.rejects.collect()) == [
        ("number of fields", good[:-2]), ("number of fields", good + ",y"), ("open quote", '"' + good)]
    plan = found.rows.select("c0")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_csv(") <= 3, plan
    plan = _lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == plan.count("THEN regexp_replace(") > 0, plan
