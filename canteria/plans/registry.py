"""Names of all core queries, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shipped
from . import found, provenance, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of problems 1 to 5 and those of the provenance store."""
    problems = {name: getattr(found, name) for name in dir(found) if re.match(r"p\d_", name)}
    return {name: shipped(f) for name, f in (problems | {f.__name__: f for f in provenance.QUERIES}).items()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
