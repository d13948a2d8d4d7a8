"""The corpus pipeline: five stages, each one operator of ``orderlens.llm``.

Every stage works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. Empty and null texts pass each stage by
the defined case of its operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.llm import decontaminate, near_dedup, packing, prefix_free, quality
from orderlens.session import scratch_path


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects (score under 0.5) go. It learns
    from the labels of the documents that are there, as op10 does."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class stays, the smallest id."""
    return near_dedup.keep_one(docs)


def suffix_array_dedup(spark, docs, sf_dir):
    """Repeated strings of 100 bytes go; n_chars follows the text."""
    out = prefix_free.remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_decontamination(spark, docs, sf_dir):
    """Contaminated documents go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir):
    """What is left, packed into sequences of 2048 tokens: a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the tokenizer and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
