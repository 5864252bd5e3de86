"""The library's operators applied to the driver tables, each beside equivalent SQL."""

from __future__ import annotations

from tidemark.demo import evaluation, facts, gates, history, quality, records, registry, scoring, versions  # noqa: F401  (they register queries)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
