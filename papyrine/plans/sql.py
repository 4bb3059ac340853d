"""Statements of the core that read as SQL in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from papyrine.sources.tables import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings search_hits chunks render_samples "
    "training_samples eval_cases annotation_pairs case_scores annotators split_targets"
).split()


def run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run a statement over the tables it reads; they are bound under names of their own when the statement is analysed, so that no
    view of the session is touched."""
    for name in TABLES:
        bound, times = re.subn(rf"\b(from|join) {name}\b", rf"\1 papyrine_{name}", statement)
        if times:
            statement = re.sub(rf"(?<!papyrine_)\b{name}\.", f"papyrine_{name}.", bound)
            table(spark, sf_dir, name).createOrReplaceTempView(f"papyrine_{name}")
    return spark.sql(statement)


def registered(statements: dict[str, str | tuple[str, str]]) -> tuple[dict, dict]:
    """(queries, sql) from statements: one text for both engines, or (Spark, DuckDB)."""
    queries, sql = {}, {}
    for name, text in statements.items():
        here, there = (text, text) if isinstance(text, str) else text

        def query(spark: SparkSession, sf_dir: str, here: str = here) -> DataFrame:
            return run(spark, sf_dir, here)

        query.__name__ = name
        queries[name], sql[name] = query, there
    return queries, sql
