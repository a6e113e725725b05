"""All registered queries of the tick operators with their DuckDB SQL."""

from __future__ import annotations

from tickloom.plans import exits, features, fitted, held, more, recursive, selection, series, shaping, storing, training  # noqa: F401  register their queries
from tickloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
