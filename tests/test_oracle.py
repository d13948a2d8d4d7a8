"""Every registered query against its DuckDB oracle on the smallest data."""

import pytest

import __spark_entry__ as entry
from orderlens.verify import compare

from conftest import SF_SMALL

# the optional subpackage has tests of its own
QUERIES = entry.core_queries()
ORACLE = entry.core_oracle_sql()


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == entry.entry(spark).columns


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_small, key):
    r = compare(spark, duck_small, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert r["columns_match"], r
    assert r["types_match"], r
    assert r["exact"], r
