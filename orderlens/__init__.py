"""orderlens: marketplace order-item analytics as Spark DataFrame jobs.

Layout
------
- ``config``      thresholds and domain values (fixed values live here only)
- ``sources``     readers, the labelled multi-source ingest, writers, and the
                  adapter that derives order-item tables from the driver's tables
- ``functions``   Column-expression helpers (SKU regexes, calendar, statistics)
- ``operators``   DataFrame -> DataFrame building blocks (cleaning, prefix match,
                  star-schema model, distributed global rank / running sum)
- ``plans``       the analyses: one function per query key, plus the registry
- ``streaming``   incremental (availableNow) ingest of landing files
"""

from orderlens.config import Params

__all__ = ["Params"]
