"""Order exports as CSV, with their malformed lines set aside (IO1).

A file is read line by line as text, so that a large one is split over tasks,
and parsed with the header's columns. A line that has other than the header's
number of fields, or an odd number of quotes, is no row: it goes to a reject
table with its source, file, text and reason, and is counted for each source.

A field may hold line breaks only if the reader takes whole files. So the lines
with an odd number of quotes are counted first (``line_breaks="auto"``, one scan
of the text): where there are none, no field holds a break and the file is
split; where there are some, Spark's multi-line reader takes the file.
``"reject"`` splits all the same and sets such lines aside, ``"allow"`` reads
whole files without the count.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import scratch_path

REJECTS = "shop string, file string, reason string, record string"
_CORRUPT = "_corrupt"
#: The export's dialect; null is an empty field.
DIALECT = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


class Export(NamedTuple):
    """Rows under the header's names (text), and rejected records."""

    rows: DataFrame
    rejects: DataFrame


def _odd_quotes(line):
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines without a byte-order mark and a carriage return at the end; blank ones count as no record."""
    marked = F.startswith("value", F.lit("\ufeff")) | F.contains("value", F.lit("\r"))  # few lines need the expression
    line = F.when(marked, F.regexp_replace("value", "^\\uFEFF|\r$", "")).otherwise(F.col("value"))
    text = spark.read.text(path).select(F.input_file_name().alias("file"), line.alias("line"))
    return text.where(F.trim("line") != "")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file's first line."""
    names = spark.read.options(header=True, **{k: DIALECT[k] for k in ("quote", "escape")}).csv(path).columns
    return [n.removeprefix("\ufeff") for n in names]


def _fields(names: list[str], reserved: str) -> str:
    if reserved in names:
        raise ValueError(f"an export has a column {reserved}")
    return ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in [*names, reserved])


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """True if some line has an odd number of quotes, as a field over several lines makes."""
    return bool(_lines(spark, path).where(_odd_quotes(F.col("line"))).limit(1).count())


def read_csv_checked(spark: SparkSession, path: str, label: str, line_breaks: str = "auto") -> Export:
    """An export's rows and rejects. ``label`` names the source of rejects."""
    if line_breaks not in ("auto", "allow", "reject"):
        raise ValueError("line_breaks is auto, allow or reject")
    names = header_of(spark, path)
    whole_files = line_breaks == "allow" or (line_breaks == "auto" and has_line_breaks(spark, path))
    schema = _fields(names, _CORRUPT)
    if whole_files:
        # without column pruning: a row's number of fields is judged whatever a query reads
        read = spark.read.schema(schema).options(header=True, multiLine=True, columnPruning=False, enforceSchema=True, **DIALECT).csv(path)
        parsed = read.select(F.input_file_name().alias("file"), F.col(_CORRUPT).alias("line"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
        # written once: Spark refuses a query on such a file that reads rejected records alone
        path = scratch_path(spark, "export-records")
        parsed.write.parquet(path)
        parsed = spark.read.schema(parsed.schema).parquet(path)
        good, odd = F.col("line").isNull(), F.lit(False)
    else:
        lines = _lines(spark, path)
        odd = _odd_quotes(F.col("line"))
        row = F.from_csv(F.when(~odd, F.col("line")), schema, {**DIALECT, "columnPruning": "false"})
        parsed = lines.withColumn("row", row)
        # compared as one value: a condition on each field would write the parsing out for each
        header = F.struct(*[F.lit(n).alias(n) for n in names], F.lit(None).cast("string").alias(_CORRUPT))
        good = ~odd & F.col(f"row.{_CORRUPT}").isNull() & ~F.col("row").eqNullSafe(header)
    rows = parsed.where(good).select(*[F.col("row").getField(n).alias(n) for n in names])
    bad = parsed.where(~good) if whole_files else parsed.where((odd | F.col(f"row.{_CORRUPT}").isNotNull()) & ~_is_header(names))
    reason = F.when(odd, F.lit("open quote")).otherwise(F.lit("number of fields"))
    rejects = bad.select(F.lit(label).alias("shop"), "file", reason.alias("reason"), F.col("line").alias("record"))
    return Export(rows, rejects)


def _is_header(names: list[str]):
    """A line that is the header: each file's first one (and those of files that were put together)."""
    # a line without the first name's letters is none, and need not be parsed once more to see that
    same = F.lit(True) if '"' in names[0] else F.contains("line", F.lit(names[0]))
    for n in names:
        same = same & F.col("row").getField(n).eqNullSafe(F.lit(n))
    return same


def reject_counts(rows: DataFrame, rejects: DataFrame, label_col: str = "shop") -> DataFrame:
    """For each source: rows taken, and records rejected for each reason."""
    taken = rows.groupBy(F.col(label_col).alias("shop")).agg(F.count(F.lit(1)).alias("n_rows"))
    bad = rejects.groupBy("shop").agg(
        F.count_if(F.col("reason") == "number of fields").alias("n_number_of_fields"),
        F.count_if(F.col("reason") == "open quote").alias("n_open_quote"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return taken.join(bad, "shop", "full").select("shop", zero("n_rows"), zero("n_number_of_fields"), zero("n_open_quote"))
