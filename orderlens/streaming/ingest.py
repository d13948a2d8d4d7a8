"""Streaming variant of the labelled ingest + cleaning step (IO1 + CL1-CL7)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderlens.config import DEFAULT, Params
from orderlens.operators.clean import clean_orders


def ingest_stream(
    spark: SparkSession,
    landing: dict[str, str],
    schema: T.StructType,
    sink_path: str,
    checkpoint: str | None = None,
    params: Params = DEFAULT,
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Stream Parquet landing files of several shops into the cleaned table.

    ``landing`` maps the shop label to its landing folder; ``schema`` is the
    declared export schema (a file stream never infers). ``available_now``
    processes what has landed and stops (a scheduled incremental batch);
    otherwise the stream keeps running. Without a ``checkpoint`` the stream's
    progress is kept beside its sink, at ``<sink_path>-checkpoint``: each call
    for the same sink goes on where the last one stopped.
    """
    streams = []
    for label, path in landing.items():
        s = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path)
            .withColumn("shop", F.lit(label))
        )
        streams.append(s)
    union = streams[0]
    for s in streams[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    cleaned = clean_orders(union, params).withColumn("order_month", F.date_format("created_at", "yyyy-MM"))
    writer = (
        cleaned.writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint or f"{sink_path.rstrip('/')}-checkpoint")
        .partitionBy("order_month")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
