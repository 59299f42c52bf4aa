"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    from ..session import reach_workers
    from . import registry

    def reaching(query):
        return lambda spark, sf_dir: query(reach_workers(spark), sf_dir)

    return {name: reaching(query) for name, query in registry.QUERIES.items()}


def oracle_sql() -> dict:
    from . import registry

    return registry.SQL
