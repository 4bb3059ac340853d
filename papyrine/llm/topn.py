"""Top N items within every group, in two salted stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.sources.tables import table

#: Subgroups of a group in the first stage; a group's rows meet in one task only after N are left of each subgroup.
SUBGROUPS = 64


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, subgroups: int = SUBGROUPS) -> DataFrame:
    """The n best items of every group: columns (group, item, score, rank).

    An item stands with its highest score; equal scores are ordered by item, ascending. Rows with a null group, a
    null item or a score that is null, NaN or infinite don't count; repeated rows change nothing; an empty table
    gives an empty result; other columns of df, whatever their names, are ignored.

    The best score of each (group, item) is found with map-side combine. Each group is then hashed by item into
    subgroups that are ranked and cut to n on their own, and only the survivors, at most n * subgroups of a group,
    are ranked together.
    """
    hits = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    finite = F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != F.lit(float("inf")))
    best = hits.where(F.col("g").isNotNull() & F.col("i").isNotNull() & finite).groupBy("g", "i").agg(F.max(F.col("s") + F.lit(0.0)).alias("s"))
    salted = best.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(subgroups)))
    order = [F.col("s").desc(), F.col("i").asc()]
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("r") <= n)
    last = first.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("r") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").cast("int").alias("rank"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_top_chunks(spark, sf_dir).select("file_id", "chunk_id")


def p1_top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(table(spark, sf_dir, "search_hits"), "file_id", "chunk_id", "score", 5)


_RANKED = """
with best as (
  select file_id, chunk_id, max(score) as score from search_hits
  where file_id is not null and chunk_id is not null and score is not null and isfinite(score)
  group by file_id, chunk_id),
ranked as (
  select *, cast(row_number() over (partition by file_id order by score desc, chunk_id) as int) as rank from best)
"""

QUERIES = {"p1_found": p1_found, "p1_top_chunks": p1_top_chunks}
SQL = {
    "p1_found": _RANKED + "select file_id, chunk_id from ranked where rank <= 5",
    "p1_top_chunks": _RANKED + "select file_id, chunk_id, score, rank from ranked where rank <= 5",
}
