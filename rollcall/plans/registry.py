"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans import core, drift, timestamps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = core.QUERIES | {"p6_found": timestamps.p6_found, "p6_utc": timestamps.p6_utc, "p7_found": drift.p7_found, "p7_table": drift.p7_table, "p7_failed_casts": drift.p7_failed_casts}
SQL: dict[str, str] = core.SQL
FLAGSHIP = "entity_page_2"
