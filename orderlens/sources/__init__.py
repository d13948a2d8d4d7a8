"""Readers, writers, the labelled multi-source ingest and the test-data adapter."""

from orderlens.sources.adapter import (
    base_codes,
    cost_table,
    order_items,
    raw_order_sources,
)
from orderlens.sources.io import (
    export_csv,
    ingest_labelled,
    read_cost_csv,
    read_table,
    write_table,
)

__all__ = [
    "base_codes",
    "cost_table",
    "order_items",
    "raw_order_sources",
    "export_csv",
    "ingest_labelled",
    "read_cost_csv",
    "read_table",
    "write_table",
]
