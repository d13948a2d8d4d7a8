"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

Every callable builds a fresh lazy :class:`Model` for the folder (nothing is
cached between calls) and returns the query's DataFrame. Building it may run
small planning jobs (sizes, code lengths), the checkpoints of global sorts and, in
queries about written tables, the writes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.config import ADAPTER, Params
from orderlens.operators.model import Model
from orderlens.plans import (
    campaign, cohort, dashboard, incomplete, ingest, model_tables, payment, rfm, seasonality, sku_report,
)

_MODULES = [ingest, model_tables, sku_report, incomplete, campaign, payment, seasonality, cohort, rfm, dashboard]

QUERY_KEYS: dict[str, Callable[[Model], DataFrame]] = {}


def register(fn: Callable[[Model], DataFrame], key: str | None = None) -> None:
    QUERY_KEYS[key or fn.__name__] = fn


def _collect_keys() -> None:
    for mod in _MODULES:
        for name in getattr(mod, "__all__", None) or [n for n in dir(mod) if not n.startswith("_")]:
            fn = getattr(mod, name)
            if callable(fn) and getattr(fn, "__module__", None) == mod.__name__:
                register(fn, name)


_collect_keys()


def queries(params: Params = ADAPTER) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Model(spark, sf_dir, params))

    return {k: bind(fn) for k, fn in QUERY_KEYS.items()}
