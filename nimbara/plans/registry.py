"""Registry of the station queries: name -> function and name -> SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows.

    ``round(x, d) + 0.0`` gets the same nudge as ``base.r``, so that halves that
    differ in the last bit round alike.
    """

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r", (\d)\) \+ 0\.0(?!\d)", lambda m: f" + 1e-{int(m[1]) + 3}, {m[1]}) + 0.0", sql)
        return f

    return add


from nimbara.plans import q_aggregates, q_joins, q_models, q_more, q_qc, q_sources, q_time  # noqa: E402, F401
