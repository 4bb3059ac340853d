"""Collects the queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.plans import documents, evidence, layout, metrics, relational, relations, retrieval, rules, sections, state, verification

#: A later module's query takes the place of an earlier one's of the same name.
MODULES: tuple = (retrieval, relational, documents, rules, layout, sections, metrics, verification, evidence, state, relations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        for name in module.QUERIES:
            found.pop(name, None)
        found.update(module.SQL)
    return found
