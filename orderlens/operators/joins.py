"""Join helpers: broadcast only behind a size check in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a row takes besides its values, and a value of fixed width.
ROW_BYTES, VALUE_BYTES = 32, 8


def fits(df: DataFrame, max_bytes: int) -> bool:
    """True if the rows take at most ``max_bytes``, by their number and the
    measured length of their strings. The strings are read only if the fixed
    part of the rows (a count, from the file footers where it can) fits."""
    width = ROW_BYTES + VALUE_BYTES * len(df.columns)
    if df.count() * width > max_bytes:
        return False
    text = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    lengths = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("bigint") for c in text]
    n, letters = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(lengths, F.lit(0))), F.lit(0))).first()
    return n * width + letters <= max_bytes


def checked_broadcast(df: DataFrame, max_bytes: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it takes at most ``max_bytes``.

    Meant for input-sized lookup tables (a cost table, a code list): the check
    is one or two cheap jobs over that table, never over the fact. Beyond the
    bound the frame is returned unchanged and Spark plans a shuffle join (AQE
    splits a skewed partition of it).
    """
    return (F.broadcast(df), True) if fits(df, max_bytes) else (df, False)
