"""All query plans and their SQL."""

from __future__ import annotations

from . import contamination, curation, items, psychometrics, registry, state, tracking  # noqa: F401  they register themselves


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
