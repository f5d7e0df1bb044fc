"""All registered queries of the library and their SQL."""

from __future__ import annotations

from lectern import registry
from lectern.plans import aggregates, catalogue, dates, joins, layout, lookup, matching, outlines, phrases, search, sinks, state, texts, transforms, windows, words  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def covered() -> dict[str, list[str]]:
    """Which queries cover each row of the operator inventory."""
    out: dict[str, list[str]] = {}
    for name, rows in registry.COVERS.items():
        for row in rows:
            out.setdefault(row, []).append(name)
    return out
