"""Chat formatting with collapse of cumulative snapshots.

Conversation logs often hold the same conversation again and again, a few turns
longer each time. A rolling hash over a conversation's turns gives the hash of
each of its prefixes; a conversation whose whole hash is a proper prefix of
another one goes (an anti-join on the hashes), and of equal ones the smallest
id stays. What is left, the maximal conversations, is rendered.

The rolling hash is the exclusive or of two 64-bit hashes of (place, role,
text), so it can be taken over chunks of turns and joined: no window and no
collected list holds more than the turns of a chunk, whatever the length of a
conversation. Rendered conversations come in parts of ``PART`` turns.

Defined cases: rows that repeat in all four columns count once; turns are
ordered by turn, role and text (nulls first); null role or text renders as the
empty string but differs from it in comparisons; rows with a null conv_id make
one conversation; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import write_table

CHUNK = 256
PART = 256


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn with its place from 1, the conversation's number of turns and
    the hash ``(p1, p2)`` of the turns up to it."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    # chunks of turn numbers: a long conversation is several groups
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / F.lit(CHUNK)))
    chunk = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    ordered = write_table(rows.withColumn("nth", F.row_number().over(chunk)), "turns")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("conv_id", "chunk").agg(F.count("*").alias("size"))
    sizes = sizes.select("conv_id", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n_turns"))
    placed = _join(ordered, sizes).withColumn("place", F.col("nth") + F.col("offset"))
    parts = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    hashed = placed.withColumn("h1", F.xxhash64(F.lit(1), *parts)).withColumn("h2", F.xxhash64(F.lit(2), *parts))
    up_to = chunk.rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.withColumn("c1", F.bit_xor("h1").over(up_to)).withColumn("c2", F.bit_xor("h2").over(up_to))
    whole = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("w1"), F.bit_xor("h2").alias("w2"))
    earlier = whole.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(f"w{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)))
    both = [F.col(f"c{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"p{k}") for k in (1, 2)]
    return write_table(_join(rolling, earlier).select("conv_id", "place", "n_turns", "role", "text", *both), "prefixes")


def _join(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows with what belongs to their chunk; nulls match."""
    own = chunks.withColumnRenamed("conv_id", "_conv").withColumnRenamed("chunk", "_chunk")
    return rows.join(own, rows["conv_id"].eqNullSafe(own["_conv"]) & rows["chunk"].eqNullSafe(own["_chunk"])).drop("_conv", "_chunk")


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that no other one extends: conv_id, n_turns, and how many
    logged conversations they stand for (equal ones and prefixes)."""
    key = [F.col("place").alias("n"), "p1", "p2"]
    least = F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("m")
    logged = turns.where("place = n_turns").groupBy(*key).agg(least, F.count("*").alias("copies"))
    logged = write_table(logged.select("n", "p1", "p2", F.col("m.conv_id").alias("conv_id"), "copies"), "logged")
    longer = turns.where("place < n_turns").select(*key).distinct()
    kept = logged.join(longer, ["n", "p1", "p2"], "left_anti").select(F.col("conv_id").alias("_kept"), F.col("n").alias("_n"))
    within = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept"))).select("conv_id", F.col("place").alias("n"), "p1", "p2", "n_turns")
    return within.join(logged.drop("conv_id"), ["n", "p1", "p2"], "left").groupBy("conv_id", "n_turns").agg(F.sum("copies").alias("n_snapshots"))


def render(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, n_snapshots, text."""
    turns = prefixes(conversations)
    kept = maximal(turns).withColumnRenamed("conv_id", "_kept").drop("n_turns")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept"))).withColumn("line", line).withColumn("part", F.floor((F.col("place") - 1) / PART))
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return rows.groupBy("conv_id", "part", "n_turns", "n_snapshots").agg(lines.alias("l")).select("conv_id", "part", "n_turns", "n_snapshots", F.array_join("l.line", "").alias("text"))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """Render all maximal conversations."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t),
e AS (
  SELECT *, coalesce(length(role) || ':' || role, 'null') || '/' || coalesce(length(text) || ':' || text, 'null') || '/' AS turn_text,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line
  FROM r),
p AS (SELECT *, string_agg(turn_text, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM e),
logged AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE place = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM logged WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns)),
snapshots AS (
  SELECT p.conv_id, sum(logged.copies) AS n_snapshots FROM p JOIN kept USING (conv_id) JOIN logged USING (prefix) GROUP BY p.conv_id)
SELECT conv_id, CAST((place - 1) // 256 AS BIGINT) AS part, n_turns, CAST(n_snapshots AS BIGINT) AS n_snapshots, string_agg(line, '' ORDER BY place) AS text
FROM p JOIN snapshots USING (conv_id)
GROUP BY conv_id, part, n_turns, n_snapshots
"""
