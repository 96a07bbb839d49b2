"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from gridloom.plans import aggregates, extras, relational, scalars, spatial, workflows  # noqa: F401
from gridloom.plans.bind import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
