"""The written model: versioned folders, and a commit that readers follow (IO6).

A version's files are written beside the older ones and never changed. The last
step of a write appends one small file to ``_commits``, which names the folders
that make up each table; readers take the newest commit. So they see the old
model or the new one and never half of it, a job that fails leaves the old one in
place, and a job may read the model that it replaces.

The large tables are partitioned by month, and
a commit lists their folders month by month with the number of rows and the range
of order numbers. ``refresh`` merges new lines into the model: it finds the
orders that they belong to in the months whose range of order numbers they meet,
writes the months that change, and names the other months' folders again without
reading them. The small dimensions come from the line groups (product, carrier,
carrier type and month, with the first and last day), not from the lines. The
dashboard's sums of lines and orders are kept by month in the same way.

    base/<table>/version=<v>/order_month=<yyyy-MM>/...   months
    base/<table>/version=<v>/...                         small dimensions
    base/_commits/...                                    one JSON row a version
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlens.config import DEFAULT, Params
from orderlens.operators import model as md
from orderlens.session import delete_folder, release_shuffles, scratch_path

MONTH = "order_month"
UNDATED = "undated"
#: Tables partitioned by month, and the column whose range a commit keeps.
MONTHLY = {"fact_order_item": "order_number", "dim_order": "order_number", "line_groups": None, "line_sales": None, "order_sales": None}
SMALL = ("dim_product", "dim_date", "dim_shipping_provider")
#: Tables of a row for each line or order. They are dealt into months by some groups of
#: months at a time, of so many bytes together, so that only these are shuffled at once.
BY_GROUPS, GROUPS, GROUP_BYTES = ("fact_order_item", "dim_order"), 16, 512 << 20
#: A month of so many appended folders is written anew as one.
MAX_FOLDERS = 8
COMMIT = "version long, parent long, id string, committed_at double, tables string"


class Part(NamedTuple):
    """A folder: its month ('' if the table has none), the version that wrote
    it, how many months that version wrote, rows, least and greatest key."""

    month: str
    version: str
    of: int
    n_rows: int
    low: int | None
    high: int | None


class ConcurrentRefresh(RuntimeError):
    """Another write was committed since this one began; nothing is changed."""


def order_month(date: str = "order_date"):
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED)).alias(MONTH)


def _parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows to a folder of the version that is being written, well compressed."""
    df.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def _matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of the orders in ``keys``, or of the others; lines without an order
    key make an order too."""
    keys = keys.select(*[F.col(k).alias(f"key_{k}") for k in md.ORDER_KEY])
    return rows.join(keys, [rows[k].eqNullSafe(keys[f"key_{k}"]) for k in md.ORDER_KEY], how)


class ModelStore:
    """A written model in ``base``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str, params: Params = DEFAULT):
        self.spark, self.base, self.params = spark, base.rstrip("/"), params
        self._own: list[str] = []  # scratch folders of the write that runs

    # --- reading --------------------------------------------------------------------

    def commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.base}/_commits")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _newest(self) -> dict | None:
        found = self.commits()
        row = None if found is None else found.orderBy(F.desc("version"), "committed_at", "id").first()
        return row and row.asDict()

    def version(self) -> int | None:
        """The number of the newest commit; None if nothing is written."""
        newest = self._newest()
        return newest and newest["version"]

    def _tables(self, commit: dict | None) -> dict[str, dict]:
        if commit is None:
            return {}
        return {name: t | {"parts": [Part(*p) for p in t["parts"]]} for name, t in json.loads(commit["tables"]).items()}

    def _read(self, name: str, table: dict, months: Iterable[str] | None = None) -> DataFrame:
        """A table, or some of its months. A version all of whose folders are
        asked for is one path."""
        wanted = None if months is None else set(months)
        by_version = defaultdict(list)
        for p in table["parts"]:
            if wanted is None or p.month in wanted:
                by_version[p.version].append(p)
        schema = StructType.fromJson(table["schema"])
        paths = []
        for version, parts in by_version.items():
            folder = f"{self.base}/{name}/version={version}"
            paths += [folder] if len(parts) == parts[0].of else [f"{folder}/{MONTH}={p.month}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.base}/{name}").parquet(*paths)
        return found.select(*schema.names)  # without the version

    def table(self, name: str) -> DataFrame:
        """A table of the newest version."""
        commit = self._newest()
        if commit is None:
            raise FileNotFoundError(f"no model is written in {self.base}")
        return self._read(name, self._tables(commit)[name])

    def row_counts(self) -> DataFrame:
        """SM9: rows of every table, as counted when they were written."""
        tables = self._tables(self._newest())
        rows = [(name, sum(p.n_rows for p in tables[name]["parts"])) for name in md.MODEL_TABLES if name in tables]
        return self.spark.createDataFrame(rows, "table_name string, n_rows long")

    def paths(self) -> dict[str, str]:
        """The folder of each table's newest version (all of it after ``build``)."""
        tables = self._tables(self._newest())
        return {n: f"{self.base}/{n}/version={max(t['parts'], key=lambda p: int(p.version.split('-')[0])).version}"
                for n, t in tables.items() if t["parts"]}

    def expire(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the newest ``keep`` commits names.
        Folders of versions that are not committed yet are left alone."""
        found = self.commits()
        rows = [] if found is None else found.orderBy(F.desc("version"), "committed_at", "id").limit(max(1, keep)).collect()
        if not rows:
            return []
        named = {(name, p.version, p.month) for row in rows for name, t in self._tables(row.asDict()).items() for p in t["parts"]}
        paths = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = paths(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for name in (*MONTHLY, *SMALL):
            depth = f"version=*/{MONTH}=*" if name in MONTHLY else "version=*"
            for status in fs.globStatus(paths(f"{self.base}/{name}/{depth}")) or []:
                values = dict(x.split("=", 1) for x in status.getPath().toString().split("/") if x.startswith(("version=", f"{MONTH}=")))
                if int(values["version"].split("-")[0]) <= rows[0]["version"] and (name, values["version"], values.get(MONTH, "")) not in named:
                    fs.delete(status.getPath(), True)
                    gone.append(status.getPath().toString())
        return gone

    # --- writing --------------------------------------------------------------------

    def build(self, parsed: DataFrame, cost: DataFrame) -> int:
        """Write the whole model from parsed lines; replaces what was there."""
        return self._version(parsed, cost, "build")

    def refresh(self, parsed: DataFrame, cost: DataFrame, mode: str = "append") -> int:
        """Merge parsed lines into the model. ``append``: they come on top of the
        lines that are there, also of orders that are there. ``replace``: they
        are all lines of their orders, whose older lines go."""
        if mode not in ("append", "replace"):
            raise ValueError("mode is append or replace")
        return self._version(parsed, cost, mode)

    def _version(self, parsed: DataFrame, cost: DataFrame, mode: str) -> int:
        try:
            return self._write_version(parsed, cost, mode)
        finally:  # all tables are written, or none counts
            while self._own:
                delete_folder(self.spark, self._own.pop())

    def _write_version(self, parsed: DataFrame, cost: DataFrame, mode: str) -> int:
        newest = self._newest()
        before = {} if mode == "build" else self._tables(newest)
        parent = newest["version"] if newest else 0
        number, version = parent + 1, f"{parent + 1}-{uuid.uuid4().hex[:8]}"
        lines = md.fact_order_item(parsed, self.params, extra=("pay_method",)).select("*", order_month())
        if before:
            tables = self._merged(before, lines, version, mode)
        else:
            fact = self._written("fact_order_item", lines, version)
            tables = {"fact_order_item": fact, "dim_order": self._written("dim_order", self._orders(self._read("fact_order_item", fact)), version)}
            tables["line_groups"] = self._written("line_groups", _line_groups(self._read("fact_order_item", fact)), version)
            tables |= self._sales(tables, {}, None, None, version)
        groups = self._read("line_groups", tables["line_groups"])
        days = groups.agg(F.min("first_day").alias("lo"), F.max("last_day").alias("hi"))
        small = {
            "dim_product": md.dim_product(groups, cost),
            "dim_date": md.calendar(md.date_spine(days)),
            "dim_shipping_provider": md.dim_shipping_provider(groups),
        }
        for name, df in small.items():
            tables[name] = self._written(name, df, version)
        self._commit(number, parent, tables)
        return number

    def _orders(self, lines: DataFrame) -> DataFrame:
        """Orders in the month of their first line, with the last day and the
        number of undated lines, which tell where an order's lines are."""
        return md.dim_order(lines, self.params, spans=True).select("*", order_month())

    def _written(self, name: str, df: DataFrame, version: str) -> dict:
        """Write one table's new folders; what a commit has to know of them."""
        path = f"{self.base}/{name}/version={version}"
        if name not in MONTHLY:
            _parquet(df, path)
            back = self.spark.read.schema(df.schema).parquet(path)
            return {"schema": json.loads(df.schema.json()), "parts": [Part("", version, 1, back.count(), None, None)]}
        # the months' rows in files of even size: a hot month is split
        for rows in self._groups(df) if name in BY_GROUPS else [df]:
            _parquet(rows.hint("rebalance", MONTH), path, MONTH)
            release_shuffles(self.spark)
        back = self.spark.read.schema(df.schema).parquet(path)
        key = MONTHLY[name]
        ends = [F.min(key).alias("low"), F.max(key).alias("high")] if key else [F.lit(None).alias("low"), F.lit(None).alias("high")]
        rows = back.groupBy(MONTH).agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # one a month
        parts = [Part(r[MONTH], version, len(rows), r["n"], r["low"], r["high"]) for r in sorted(rows, key=lambda r: r[MONTH])]
        return {"schema": json.loads(df.schema.json()), "parts": parts}

    def _groups(self, df: DataFrame) -> Iterator[DataFrame]:
        """The rows, some groups of whole months after the others. They are written
        once as they come, which needs no shuffle, and a group's rows are deleted
        when the caller asks for the next one."""
        base = scratch_path(self.spark, "groups")
        _parquet(df.withColumn("_group", F.pmod(F.hash(MONTH), F.lit(GROUPS))), base, "_group")
        release_shuffles(self.spark)
        paths = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = paths(base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted((s.getPath() for s in fs.globStatus(paths(f"{base}/_group=*")) or []), key=str)
        sizes = [fs.getContentSummary(p).getLength() for p in found]
        begin = 0
        while begin < max(1, len(found)):  # a table without rows is written too
            end = begin + 1
            while end < len(found) and sum(sizes[begin : end + 1]) <= GROUP_BYTES:
                end += 1
            own = [p.toString() for p in found[begin:end]]
            yield self.spark.read.schema(df.schema).parquet(*own) if own else self.spark.createDataFrame([], df.schema)
            for path in own:
                delete_folder(self.spark, path)
            begin = end
        delete_folder(self.spark, base)

    def _scratch(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"refresh-{name}")
        _parquet(df, path)
        release_shuffles(self.spark)
        self._own.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _merged(self, before: dict, lines: DataFrame, version: str, mode: str) -> dict:
        """The monthly tables after new lines."""
        lines = self._scratch(lines, "lines")
        keys = self._scratch(lines.select(*md.ORDER_KEY).distinct(), "keys")
        ends = keys.agg(F.min("order_number").alias("low"), F.max("order_number").alias("high"), F.count_if(F.col("order_number").isNull()).alias("none")).first()

        # orders of the new lines that are there already, and the months of their lines
        dim, fact = before["dim_order"], before["fact_order_item"]
        near = {p.month for p in dim["parts"] if ends["none"] or p.low is None or (ends["low"] is not None and p.low <= ends["high"] and p.high >= ends["low"])}
        known = self._scratch(_matching(self._read("dim_order", dim, near), keys, "left_semi"), "known")
        months = lambda df: {r[0] for r in df.distinct().collect()}  # noqa: E731  one row a month
        span = F.sequence(F.trunc("order_date", "MM"), F.trunc("last_order_date", "MM"), F.expr("INTERVAL 1 MONTH"))
        dim_months = months(known.select(MONTH))
        fact_months = months(known.where("order_date IS NOT NULL").select(F.explode(span).alias("d")).select(F.date_format("d", "yyyy-MM")))
        fact_months |= {UNDATED} if known.where("n_undated > 0").limit(1).count() else set()

        whole = lines
        if mode == "append" and fact_months:
            older = _matching(self._read("fact_order_item", fact, fact_months), keys, "left_semi")
            whole = lines.unionByName(older.select(*lines.columns))
        orders = self._scratch(self._orders(whole), "orders")

        tables = {"dim_order": self._rewritten("dim_order", before, orders, dim_months | months(orders.select(MONTH)), keys, version)}
        new_months = months(lines.select(MONTH))
        if mode == "replace":
            touched = fact_months | new_months
            tables["fact_order_item"] = self._rewritten("fact_order_item", before, lines, touched, keys, version)
        else:  # appended months get a folder more; one that has many is written anew
            folders = defaultdict(int)
            for p in fact["parts"]:
                folders[p.month] += 1
            touched = {m for m in new_months if folders[m] >= MAX_FOLDERS}
            tables["fact_order_item"] = self._rewritten("fact_order_item", before, lines, touched, None, version)
        written = {"schema": tables["fact_order_item"]["schema"], "parts": [p for p in tables["fact_order_item"]["parts"] if p.version == version]}
        groups = self._written("line_groups", _line_groups(self._read("fact_order_item", written)), version)
        groups["parts"] += [p for p in before["line_groups"]["parts"] if p.month not in touched]
        # an order may have become a bulk order, or be none any more: the months of all its lines change
        sales = self._sales(tables, before, fact_months | new_months, dim_months | months(orders.select(MONTH)), version)
        return tables | {"line_groups": groups} | sales

    def _sales(self, tables: dict, before: dict, line_months: set[str] | None, order_months: set[str] | None, version: str) -> dict:
        """The dashboard's sums, of some months or all; the others' folders stay."""
        orders = self._read("dim_order", tables["dim_order"])
        lines = md.without_orders(self._read("fact_order_item", tables["fact_order_item"], line_months), orders.where("is_bulk"))
        own = md.dim_order_customer(self._read("dim_order", tables["dim_order"], order_months))
        month = F.coalesce("year_month", F.lit(UNDATED)).alias(MONTH)
        out = {}
        for name, df, touched in (("line_sales", md.line_sales(lines), line_months), ("order_sales", md.order_sales(own), order_months)):
            out[name] = self._written(name, df.select("*", month), version)
            if touched is not None:
                out[name]["parts"] += [p for p in before[name]["parts"] if p.month not in touched]
        return out

    def _rewritten(self, name: str, before: dict, rows: DataFrame, touched: set[str], gone: DataFrame | None, version: str) -> dict:
        """New rows, with what the ``touched`` months keep of their older ones
        (none of the orders in ``gone``); the other months' folders stay."""
        old = before[name]
        kept = self._read(name, old, touched)
        if gone is not None:
            kept = _matching(kept, gone, "left_anti")
        table = self._written(name, rows.unionByName(kept.select(*rows.columns)), version)
        table["parts"] += [p for p in old["parts"] if p.month not in touched]
        return table

    def _commit(self, number: int, parent: int, tables: dict) -> None:
        newest = self._newest()
        if (newest["version"] if newest else 0) != parent:
            raise ConcurrentRefresh(f"version {newest['version']} was committed meanwhile")
        own = uuid.uuid4().hex
        row = (number, parent, own, time.time(), json.dumps(tables))
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").json(f"{self.base}/_commits")
        if self._newest()["id"] != own:
            raise ConcurrentRefresh(f"another version {number} was committed at the same time")


def _line_groups(lines: DataFrame) -> DataFrame:
    """What the small dimensions need of the lines: one row for each month,
    product and carrier spelling."""
    return lines.groupBy(MONTH, "product_code", "carrier", "carrier_type").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"))
