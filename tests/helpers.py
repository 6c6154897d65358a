"""Comparing results of Spark and DuckDB."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.12g}")
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def as_counter(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def rows_of(df, *order):
    """Rows as tuples, sorted by the given columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def operators_in(df) -> str:
    """The physical plan as text, without adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()
