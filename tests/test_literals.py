"""The literal cases of FIXTURES.md section 3, on tiny hand-made frames."""

import datetime as dt
import re

from pyspark.sql import functions as F

from orderlens.config import Params
from orderlens.functions.calendar import minute_diff, parse_export_timestamp, weekday0
from orderlens.functions.sku import campaign_flag, has_gift, promo_label
from orderlens.operators import model as mdl
from orderlens.operators.model import Model
from orderlens.operators.prefix_match import with_product_code
from orderlens.operators.ranking import global_rank, quintile_from_rank
from orderlens.plans import campaign, incomplete, seasonality


def test_price_allocation(spark):
    df = spark.createDataFrame(
        [(1, "s", 75000, 3000), (1, "s", 59000, 3000), (1, "s", 69000, 1500), (1, "s", 54000, 1500),
         (1, "s", 54000, 1500)], "order_number long, shop string, unit_price long, shipping_fee long")
    df = df.withColumn("paid_price", F.col("unit_price") + F.col("shipping_fee"))
    r = df.groupBy("order_number").agg(F.sum("unit_price"), F.sum("shipping_fee"), F.sum("paid_price")).first()
    assert tuple(r)[1:] == (311000, 10500, 321500)


def test_suffixes(spark):
    skus = ["X-FS", "XFS2", "X - FS", "Xfs3", "X-SL2", "X-1sticker", "X-1stickera", "X", None]
    df = spark.createDataFrame([(s,) for s in skus], "sku string")
    rows = df.select("sku", campaign_flag(F.col("sku")).alias("f"), has_gift(F.col("sku")).alias("g")).collect()
    got = {r.sku: (r.f, r.g) for r in rows}
    assert got["X-FS"] == ("FS", False)
    assert got["XFS2"] == ("FS2", False)
    assert got["X - FS"] == ("FS", False)
    assert got["Xfs3"] == ("FS3", False)
    assert got["X-SL2"] == (None, True)
    assert got["X-1sticker"] == (None, True)
    assert got["X-1stickera"] == (None, True)
    assert got["X"] == (None, False)
    assert got[None] == (None, False)


def _codes(spark, rows):
    return spark.createDataFrame(rows, "code string, ordinal long")


def test_prefix_longest_match_both_plans(spark):
    codes = _codes(spark, [("CT", 1), ("CTFS", 2)])
    df = spark.createDataFrame([("ctfs2",), ("CT-red",), ("ZZ",), (None,)], "seller_sku string")
    for strategy in ("broadcast", "distinct"):
        out = with_product_code(df, codes, strategy=strategy)
        got = {r.seller_sku: r.product_code for r in out.collect()}
        assert got == {"ctfs2": "CTFS", "CT-red": "CT", "ZZ": None, None: None}, strategy


def test_prefix_tie_first_listed_wins(spark):
    codes = _codes(spark, [("Ab", 1), ("AB", 2)])
    df = spark.createDataFrame([("ab-1",)], "seller_sku string")
    for strategy in ("broadcast", "distinct"):
        assert with_product_code(df, codes, strategy=strategy).first().product_code == "Ab"


def test_promo_label(spark):
    names = ["[A B] x", " [A] x", "x [A]", "[]x", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.l for r in df.select("n", promo_label(F.col("n")).alias("l")).collect()}
    assert got == {"[A B] x": "A B", " [A] x": "A", "x [A]": None, "[]x": None, None: None}


def test_export_timestamp(spark):
    df = spark.createDataFrame([("14 Nov 2022 10:35",), ("4 Nov 2022 10:35",), ("4 nov 2022 10:35",),
                                ("bad",), (None,)], "s string")
    got = {r.s: r.t for r in df.select("s", parse_export_timestamp(F.col("s")).alias("t")).collect()}
    assert got["14 Nov 2022 10:35"] == dt.datetime(2022, 11, 14, 10, 35)
    assert got["4 Nov 2022 10:35"] == dt.datetime(2022, 11, 4, 10, 35)
    assert got["4 nov 2022 10:35"] == dt.datetime(2022, 11, 4, 10, 35)
    assert got["bad"] is None and got[None] is None
    assert dict(df.select(parse_export_timestamp(F.col("s")).alias("t")).dtypes)["t"] == "timestamp_ntz"


def test_minute_boundary_and_sunday(spark):
    r = spark.range(1).select(
        minute_diff(F.lit(dt.datetime(2022, 1, 1, 0, 0, 59)).cast("timestamp_ntz"),
                    F.lit(dt.datetime(2022, 1, 1, 0, 1, 1)).cast("timestamp_ntz")).alias("m"),
        weekday0(F.lit(dt.date(2022, 2, 6))).alias("w"),
    ).first()
    assert r.m == 1 and r.w == 0


def _lines(spark, rows):
    """rows: (order_number, shop, status, fail_reason) -> minimal clean lines."""
    ts = dt.datetime(2022, 2, 6, 10, 0)
    data = [(o, i, s, st, "COD", reason, 100, 0, 0, 10, 110, ts, ts, None, "P-1", 1)
            for i, (o, s, st, reason) in enumerate(rows)]
    df = spark.createDataFrame(
        data,
        "order_number long, line_number int, shop string, status string, pay_method string, fail_reason string, "
        "unit_price long, seller_discount long, platform_discount long, shipping_fee long, paid_price long, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, delivered_at timestamp_ntz, seller_sku string, "
        "part_id long")
    return mdl.with_completed(df)


def test_partial_order_is_incomplete(spark):
    d = mdl.dim_order(_lines(spark, [(1, "a", "confirmed", None), (1, "a", "canceled", None)]))
    r = d.first()
    assert r.n_items == 2 and r.n_items_completed == 1 and r.is_completed is False


def test_shared_order_number_is_two_orders(spark):
    d = mdl.dim_order(_lines(spark, [(1, "a", "confirmed", None), (1, "b", "confirmed", None)]))
    assert d.count() == 2


def test_bulk_edge(spark):
    p = Params(bulk_threshold=3)
    rows = [(1, "a", "confirmed", None)] * 2 + [(2, "a", "confirmed", None)] * 3
    d = mdl.dim_order(_lines(spark, rows), p)
    kept = {r.order_number for r in mdl.dim_order_customer(d).collect()}
    assert kept == {1}


def test_two_reasons_count_under_both(spark):
    lines = _lines(spark, [(1, "a", "canceled", "r1"), (1, "a", "canceled", "r2")])
    fact = lines.withColumn("product_code", F.lit("P")).withColumn("campaign_flag", F.lit(None).cast("string")) \
        .withColumn("carrier", F.lit("K")).withColumn("order_date", F.to_date("created_at"))
    m = Model(spark, "unused")
    m.__dict__["cleaned"] = lines
    m.__dict__["fact"] = fact
    got = {r.fail_reason: (r.n_orders, r.lost_revenue) for r in incomplete.incomplete_by_reason(m).collect()}
    assert got == {"r1": (1, 200), "r2": (1, 200)}


def test_quintile_sizes(spark):
    for n, expect in [(5, [1, 1, 1, 1, 1]), (6, [2, 1, 1, 1, 1]), (192, [39, 38, 38, 38, 39])]:
        df = spark.range(1, n + 1).withColumnRenamed("id", "r")
        bins = df.select(quintile_from_rank(F.col("r"), F.lit(n)).alias("b")).groupBy("b").count().collect()
        sizes = [c for _, c in sorted((r.b, r["count"]) for r in bins)]
        assert sizes == expect, n


def test_quintile_matches_pandas_rule(spark):
    # greatest(1, ceil(5 (r-1)/(n-1))) equals cutting ranks at interpolated quantiles
    import math
    for n in (2, 3, 7, 10, 11, 99, 100, 101):
        df = spark.range(1, n + 1).withColumnRenamed("id", "r")
        got = [r.b for r in df.select(quintile_from_rank(F.col("r"), F.lit(n)).alias("b")).orderBy("r").collect()]
        edges = [1 + k * (n - 1) / 5 for k in range(6)]
        want = [1 if r == 1 else next(k for k in range(1, 6) if r <= edges[k] + 1e-12) for r in range(1, n + 1)]
        assert got == want, n
        assert all(b == max(1, math.ceil(5 * (r - 1) / (n - 1))) for r, b in zip(range(1, n + 1), got))


def test_zero_price_skipped_in_discount_depth(spark):
    im = spark.createDataFrame(
        [("P", "campaign", True, 0, 0, 0, 0), ("P", "campaign", True, 100, 10, 10, 50)],
        "product_code string, sale_group string, is_completed boolean, unit_price long, seller_discount long, "
        "platform_discount long, margin long")
    depth = F.try_divide(F.col("seller_discount") + F.col("platform_discount"), F.col("unit_price"))
    assert abs(im.agg(F.avg(depth)).first()[0] - 0.2) < 1e-12
    assert campaign is not None


def test_gap_day_is_zero_in_dense_series(spark):
    orders = spark.createDataFrame(
        [(1, dt.date(2022, 1, 1)), (2, dt.date(2022, 1, 3))], "order_number long, order_date date")
    dense = {r.date: r.n_orders for r in seasonality._daily_dense(orders).collect()}
    assert dense == {dt.date(2022, 1, 1): 1, dt.date(2022, 1, 2): 0, dt.date(2022, 1, 3): 1}


def test_global_rank_first_come(spark):
    df = spark.createDataFrame([(k, v) for k, v in [(3, 5), (1, 5), (2, 1), (4, 9)]], "k long, v long")
    got = {r.k: r.rank for r in global_rank(df, [F.col("v"), F.col("k")]).collect()}
    assert got == {2: 1, 1: 2, 3: 3, 4: 4}


def test_empty_columns_detected_from_profile(spark):
    from orderlens.operators.clean import drop_empty_columns, empty_columns
    from orderlens.sources.adapter import raw_order_sources
    from orderlens.sources.io import ingest_labelled

    from conftest import SF_SMALL

    raw = ingest_labelled(raw_order_sources(spark, SF_SMALL)).drop("customer_name", "customer_segment")
    assert empty_columns(raw) == ["warehouse"]
    assert "warehouse" not in drop_empty_columns(raw).columns


def test_prefix_plans_agree_where_upper_case_changes_length(spark):
    codes = _codes(spark, [("SSßabc", 1), ("ab", 2), ("AB", 3), ("ß", 4), ("SS", 5)])
    skus = ["ßßabc", "ssssABC-1", "a", "ab", "ß", "s", "", None, "SSx"]
    df = spark.createDataFrame([(x,) for x in skus], "seller_sku string")
    want = {"ßßabc": "SSßabc", "ssssABC-1": "SSßabc", "a": None, "ab": "ab", "ß": "SS", "s": None, "": None, None: None, "SSx": "SS"}
    for strategy in ("broadcast", "distinct"):
        got = {r.seller_sku: r.product_code for r in with_product_code(df, codes, strategy=strategy).collect()}
        assert got == want, strategy


def test_money_text_forms(spark):
    from orderlens.operators.clean import money_discount, money_failure_counts, money_numeric

    values = ["75000.0", "75000.00", "1e5", "-12.5", " 7 ", "n/a", "", None, "12.4"]
    df = spark.createDataFrame([(v, v) for v in values], "unit_price_raw string, seller_discount_raw string")
    got = [tuple(r) for r in df.select(money_numeric(F.col("unit_price_raw")), money_discount(F.col("seller_discount_raw"))).collect()]
    assert got == [(75000, 75000), (75000, 75000), (100000, 100000), (-13, 13), (7, 7), (0, 0), (0, 0), (0, 0), (12, 12)]
    assert {r.column_name: r.n_fail for r in money_failure_counts(df).collect()} == {"unit_price": 2, "seller_discount": 2}
    doubles = spark.createDataFrame([(-12.5,), (float("nan"),)], "d double")
    assert [r[0] for r in doubles.select(money_discount(F.col("d"))).collect()] == [13, 0]


def test_promo_label_strips_all_white_space(spark):
    names = [" [A] x", "\t[B] x", "\u00a0\n[C] x", "\u2003[D]", "\x1c[E]"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0][1] if r[0] and r[0][0] == "[" else r[0] for r in df.select(promo_label(F.col("n"))).collect()] == list("ABCDE")


def test_normal_tail_relative_error(spark):
    import math

    from orderlens.functions.stats import normal_upper_tail

    df = spark.range(0, 3001).select((F.col("id") / 100.0).alias("z"))
    for r in df.select("z", normal_upper_tail(F.col("z")).alias("p")).collect():
        want = 0.5 * math.erfc(r.z / math.sqrt(2.0))
        assert abs(r.p - want) <= 1e-10 * want


def test_prefix_index_equals_all_pairs(spark):
    """Nested codes of many lengths, codes that differ by case, characters
    that sort next to each other, SKUs that equal, precede and follow all codes."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aAbB-0") for _ in range(n))
    codes = sorted({word(rng.randint(1, 7)) for _ in range(300)}, key=lambda c: rng.random())
    skus = sorted({word(rng.randint(0, 9)) for _ in range(1500)} | {c + word(2) for c in codes} | {"zz", "!", ""})
    table = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code string, ordinal int")
    df = spark.createDataFrame([(x,) for x in skus], "seller_sku string")

    def best(sku):
        own = [(len(c), -i, c) for i, c in enumerate(codes) if sku.upper().startswith(c.upper())]
        return max(own)[2] if own else None

    want = {x: best(x) for x in skus}
    assert sum(v is not None for v in want.values()) > 500 and None in want.values()
    for strategy in ("broadcast", "distinct"):
        assert {r.seller_sku: r.product_code for r in with_product_code(df, table, strategy=strategy).collect()} == want, strategy
    out = with_product_code(df, table, strategy="broadcast")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(set(re.findall(r"ReusedSubquery Subquery subquery#(\d+)", plan))) == 1  # one lookup, one index
    none = with_product_code(df, table.limit(0), strategy="broadcast")
    assert none.where("product_code is not null").count() == 0 and none.count() == len(skus)


def test_promo_label_builds_no_trimmed_name(spark):
    names = ["[A] x", "  [B]", "  [C]  ", "[ D ]\t\n", "\x1c[E]\x1f", "[]x]", "[F", "x [G]", "", None, "[H\n]y\n", " [ ] "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "i int, n string")
    trimmed = F.regexp_replace("n", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    want = F.when(trimmed.rlike(r"^\[([^\]]+)\]"), F.regexp_extract(trimmed, r"^\[([^\]]+)\]", 1))
    out = df.select("n", promo_label(F.col("n")).alias("got"), want.alias("want"))
    assert [r for r in out.collect() if r.got != r.want] == []
    assert "regexp_replace" not in out.select("got")._jdf.queryExecution().optimizedPlan().toString()
