"""The filtering stages return the caller's rows as they were."""

import pytest
from pyspark.sql import functions as F

from orderlens.llm import decontaminate, near_dedup

INTERNAL = "_key _k _h _n _nth _k2 _h2 row whole key _row _id _text _hash fp block bucket node component class_row class_id n_hit items contaminated found".split()


@pytest.fixture(scope="module")
def rows(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(120)]
    texts = {1: " ".join(words), 2: " ".join(words[:118] + ["x", "y"]), 3: " ".join(words), 4: None, 5: "", 6: "", 7: "a quite different text of a few words only"}
    data = [(i, t, *range(100 * k, 100 * k + len(INTERNAL))) for k, (i, t) in enumerate([*texts.items(), (3, texts[3]), (7, texts[7])])]
    df = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in INTERNAL))
    return df, data, texts


def test_near_dedup_keeps_whole_rows_of_a_shuffled_input(rows):
    df, data, _ = rows
    shuffled = df.repartition(5, "doc_id").where(F.rand(3) >= 0)
    got = [tuple(r) for r in near_dedup.keep_one(shuffled).collect()]
    assert near_dedup.keep_one(shuffled).columns == df.columns
    assert all(r in data for r in got) and len(set(got)) == len(got)
    kept = sorted(r[0] for r in got)
    assert kept == [1, 4, 5, 6, 7]  # texts without words are classes of their own


def test_decontamination_keeps_whole_rows(spark, rows):
    df, data, texts = rows
    items = spark.createDataFrame([(1, " ".join(texts[1].split()[20:40]))], "item_id long, text string")
    got = decontaminate.remove_contaminated(df.repartition(3), items)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in data if r[0] not in (1, 2, 3)), key=str)
