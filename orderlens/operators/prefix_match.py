"""SK1: longest base code that is a case-insensitive prefix of a SKU.

The reference loops over all codes for every row (a nested loop). Here the codes
become a sorted index: the code before or at a SKU (its floor, by binary search)
either is the longest code that the SKU begins with or itself begins with it,
because everything sorted between a prefix and the string begins with that
prefix. So each code holds its chain, the codes that it begins with, best first,
and the first of the floor's chain that the SKU begins with is the answer: one
lookup, whatever lengths the codes have. Both sides are upper-cased before
anything is compared (upper-casing can change a length). The longest matching
code wins, by its own length; among equally long ones the one listed first
(lowest ordinal) wins.

Plans
-----
- *broadcast* (codes up to ``max_bytes``, measured): the index is one value, a
  scalar subquery that reads the codes once; looking it up takes no join and no
  shuffle, and a hot SKU costs nothing extra. A query that does not read the
  product code does not build it.
- *distinct-SKU* (larger code tables): only the distinct SKUs are shuffled
  (partial aggregation first), expanded to one candidate per code length,
  equi-joined to the codes, reduced with ``max_by`` and joined back; AQE
  splits a skewed SKU partition on the way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.config import DEFAULT
from orderlens.operators.joins import fits


def _keyed_codes(codes: DataFrame, code_col: str, ordinal_col: str) -> DataFrame:
    """One row per upper-cased code: its length, and the code that wins with
    its rank ``(own length, -ordinal)``."""
    code = F.col(code_col)
    rank = F.struct(F.length(code).alias("len"), (-F.col(ordinal_col)).alias("ord"))
    return (
        codes.where(code.isNotNull())
        .select(F.upper(code).alias("_pm_key"), rank.alias("_pm_rank"), code.alias("_pm_code"))
        .groupBy("_pm_key")
        .agg(F.max("_pm_rank").alias("_pm_rank"), F.max_by("_pm_code", "_pm_rank").alias("_pm_code"))
        .withColumn("_pm_len", F.length("_pm_key"))
    )


def code_lengths(keyed: DataFrame) -> list[int]:
    """Distinct code lengths, longest first: one tiny row per length reaches
    the driver, never the codes themselves."""
    rows = keyed.select("_pm_len").distinct().collect()
    return sorted((r["_pm_len"] for r in rows), reverse=True)


def with_product_code(
    df: DataFrame,
    codes: DataFrame,
    sku_col: str = "seller_sku",
    out_col: str = "product_code",
    code_col: str = "code",
    ordinal_col: str = "ordinal",
    max_bytes: int = DEFAULT.max_broadcast_bytes,
    strategy: str = "auto",
) -> DataFrame:
    """Add ``out_col`` = longest case-insensitive prefix code of ``sku_col``."""
    keyed = _keyed_codes(codes, code_col, ordinal_col)
    if strategy == "broadcast" or (strategy == "auto" and fits(keyed, max_bytes)):
        return _index_plan(df, prefix_index(keyed), sku_col, out_col)
    lengths = code_lengths(keyed)
    if not lengths:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    return _distinct_sku_plan(df, keyed, lengths, sku_col, out_col)


def prefix_index(keyed: DataFrame) -> DataFrame:
    """One row ``index``: the sorted keys, and the chain of each. A chain holds
    the codes that the key begins with, itself too, best first."""
    own = F.col("_pm_key")
    entry = F.struct("_pm_rank", "_pm_key", "_pm_code")
    prefixes = keyed.select(own, entry.alias("_pm_entry"), F.explode(F.sequence(F.lit(1), F.length(own))).alias("_pm_n"))
    prefixes = prefixes.select(F.expr("substring(_pm_key, 1, _pm_n)").alias("_pm_prefix"), own, "_pm_entry")
    # the keys that begin with a prefix, where that is a code itself
    under = prefixes.groupBy("_pm_prefix").agg(
        F.max(F.when(own == F.col("_pm_prefix"), F.col("_pm_entry"))).alias("_pm_entry"), F.collect_list(own).alias("_pm_keys"))
    linked = under.where(F.col("_pm_entry").isNotNull()).select("_pm_entry", F.explode("_pm_keys").alias("_pm_key"))
    chains = linked.groupBy("_pm_key").agg(F.sort_array(F.collect_list("_pm_entry"), asc=False).alias("_pm_chain"))
    rows = chains.agg(F.sort_array(F.collect_list(F.struct("_pm_key", "_pm_chain"))).alias("rows"))
    # steps of the binary search: the powers of two up to the number of keys, greatest first
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    steps = F.filter(powers, lambda step: step <= F.size("rows"))
    return rows.select(F.struct(F.col("rows._pm_key").alias("keys"), F.col("rows._pm_chain").alias("chains"), steps.alias("steps")).alias("index"))


def _index_plan(df: DataFrame, index: DataFrame, sku_col: str, out_col: str) -> DataFrame:
    """Floor by binary search, then the chain, as one expression that refers to
    the SKU once: every step's value is a lambda's argument. Steps that are
    columns of their own are written into each other, two or three times each,
    when Spark moves a filter on the code (that of a join on it, say) below them."""
    value, parts = index.scalar(), ("keys", "chains", "steps")

    def best(x: Column) -> Column:
        upper = x.getField("upper")

        def step(floor: Column, ahead: Column) -> Column:
            return F.when(F.get(x.getField("keys"), floor + ahead) <= upper, floor + ahead).otherwise(floor)

        floor = F.aggregate(x.getField("steps"), F.lit(-1), step)
        chain = F.filter(F.get(x.getField("chains"), floor), lambda entry: F.startswith(upper, entry.getField("_pm_key")))
        return F.get(chain, F.lit(0)).getField("_pm_code")

    # Spark takes no subquery inside such functions, so their argument is a column, which
    # it writes into the expression, as nothing else reads it: no row holds the index
    one = F.array(F.struct(*[value.getField(name).alias(name) for name in parts], F.upper(F.col(sku_col)).alias("upper")))
    return df.withColumn("_pm_one", one).withColumn(out_col, F.get(F.transform("_pm_one", best), F.lit(0))).drop("_pm_one")


def sku_code_map(skus: DataFrame, keyed: DataFrame, lengths: list[int], sku_col: str, out_col: str) -> DataFrame:
    """(sku, code) for distinct SKUs that match at least one code."""
    upper = F.upper(F.col(sku_col))
    cand = skus.select(
        F.col(sku_col), upper.alias("_pm_sku"),
        F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_pm_len"),
    ).where(F.length("_pm_sku") >= F.col("_pm_len"))
    cand = cand.withColumn("_pm_key", F.expr("substring(_pm_sku, 1, _pm_len)"))
    hit = cand.join(keyed, ["_pm_key", "_pm_len"], "inner")
    return hit.groupBy(sku_col).agg(F.max_by("_pm_code", "_pm_rank").alias(out_col))


def _distinct_sku_plan(df, keyed, lengths, sku_col, out_col):
    skus = df.select(sku_col).where(F.col(sku_col).isNotNull()).distinct()
    return df.join(sku_code_map(skus, keyed, lengths, sku_col, out_col), sku_col, "left")


def product_code_map(skus: DataFrame, codes: DataFrame, sku_col: str = "seller_sku",
                     out_col: str = "product_code", code_col: str = "code",
                     ordinal_col: str = "ordinal") -> DataFrame:
    """(sku, product_code or null) for a frame of distinct SKUs."""
    return with_product_code(skus, codes, sku_col, out_col, code_col, ordinal_col)
