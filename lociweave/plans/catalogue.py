"""Every query of the library with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociweave.plans import audit_queries, interval_queries, loci_queries, model_queries, panel_queries, reader_queries, sequence_queries  # noqa: F401
from lociweave.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
