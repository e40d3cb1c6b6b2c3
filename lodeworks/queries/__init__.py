"""Named queries over the test tables, and the SQL that each must equal."""

from __future__ import annotations

from lodeworks.queries import analytics, changes, contracts, landing, scalars, stored

_PARTS = (analytics, landing, changes, scalars, stored, contracts)


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for p in _PARTS for k, s in p.SQL.items()}
