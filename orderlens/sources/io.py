"""Scan and sink primitives (IO1-IO6).

All readers return lazy DataFrames: Catalyst prunes the columns a query does
not use and pushes its filters into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.config import EXPORT_COLUMNS
from orderlens.session import release_shuffles, scratch_path
from orderlens.sources.exports import REJECTS, Export, has_line_breaks, read_csv_checked
from orderlens.sources.schemas import SCHEMAS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """IO3: one Parquet table of a data folder, with its declared schema when
    known (no footer read on the driver to infer it)."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ingest_labelled(sources: Iterable[tuple[str, DataFrame]], label_col: str = "shop") -> DataFrame:
    """IO1: union several per-source frames, tagging each row with its source.

    Columns are matched by name; a column missing from one source is null
    there (``allowMissingColumns``), the way one shop's export may lack a
    column the other has.
    """
    out = None
    for label, df in sources:
        tagged = df.withColumn(label_col, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def read_export(spark: SparkSession, path: str, file_format: str = "csv",
                columns: dict[str, str] | None = None) -> DataFrame:
    """One shop's order export under the names used here (see ``checked_export``), without its rejects."""
    return checked_export(spark, path, "", file_format, columns).rows


def checked_export(spark: SparkSession, path: str, label: str, file_format: str = "csv",
                   columns: dict[str, str] | None = None, line_breaks: str = "auto") -> Export:
    """One shop's order export under the names used here, all values as text or
    as the file has them; cleaning gives them their types. Personal and unknown
    columns are not read. A file without one of the columns is refused, for a
    renamed header must not become a column of nulls. Malformed CSV records are
    the rejects; other formats have none."""
    columns = columns or EXPORT_COLUMNS
    if file_format == "csv":
        df, rejects = read_csv_checked(spark, path, label, line_breaks)
    else:
        df, rejects = spark.read.format(file_format).load(path), spark.createDataFrame([], REJECTS)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    return Export(df.select(*[F.col(f"`{c}`").alias(name) for c, name in columns.items()]), rejects)


def read_cost_csv(spark: SparkSession, path: str, code_col: str = "product_code",
                  cost_col: str = "cost") -> DataFrame:
    """IO4: the product cost table from a CSV file with a header.

    No inference pass: every column is read as text and only the two named
    columns are kept, the cost coerced to whole minor units (unparseable or
    empty -> null, i.e. unknown cost, never invented; halves round away from
    zero). Quoted fields may hold
    commas and doubled quotes; a UTF-8 byte-order mark before the header is
    dropped by the reader, so the first header name matches.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
    return raw.select(
        F.col(code_col).alias("product_code"),
        F.round(F.col(cost_col).try_cast("decimal(38,6)"), 0).try_cast("bigint").alias("cost"),
    )


#: Both ways the same, so that blanks, quotes, line breaks, empty strings and
#: microseconds come back as they were: null is an empty field, '' a quoted one.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "nullValue": "", "quoteAll": "false",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n",
    "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


#: Scratch exports are compressed. A reader can't split such a file, so it holds so many rows at most.
SCRATCH_CSV = {"compression": "gzip", "maxRecordsPerFile": 500_000}


def export_csv(df: DataFrame, path: str, **options) -> str:
    """IO5: CSV fallback sink with a header (one file per task, no BOM).
    ``options`` are more of the writer's own, such as the compression."""
    df.write.mode("overwrite").options(**CSV_OPTIONS, emptyValue='""', **options).csv(path)
    return path


def read_exported_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read back what ``export_csv`` wrote. Files are split over tasks unless a
    value holds a line break. The reader would take a quoted empty field for null as well, so it is told to
    deliver a character that no export holds for it."""
    raw = spark.read.schema(schema).options(**CSV_OPTIONS, emptyValue="\x00", multiLine=has_line_breaks(spark, path)).csv(path)
    strings = [f.name for f in schema.fields if f.dataType.typeName() == "string"]
    return raw.withColumns({c: F.when(F.col(c) == "\x00", F.lit("")).otherwise(F.col(c)) for c in strings})


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> str:
    """IO6: overwrite-by-name materialisation of a model table as Parquet.

    Large fact tables are best partitioned by month so date filters prune
    whole folders.
    """
    writer = df.write.mode("overwrite")
    cols = list(partition_by)
    if cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(path)
    return path


def export_csv_roundtrip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` as CSV into the shared scratch folder and read it back."""
    path = export_csv(df, scratch_path(spark, "export-csv"), **SCRATCH_CSV)
    release_shuffles(spark)
    return read_exported_csv(spark, path, df.schema)
