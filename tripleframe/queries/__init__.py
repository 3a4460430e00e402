"""Every operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleframe.queries.more import MORE
from tripleframe.queries.operations import OPERATIONS
from tripleframe.queries.selects import SELECTS

FLAGSHIP = "bgp_join"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.run for n, q in SELECTS.items()} | {n: run for n, (run, _) in (OPERATIONS | MORE).items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.oracle() for n, q in SELECTS.items()} | {n: sql for n, (_, sql) in (OPERATIONS | MORE).items()}
