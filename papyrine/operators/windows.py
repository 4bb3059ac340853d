"""Windows over groups of any size: numbering, neighbours and best rows without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.plans.runtime import cut


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df with each row's number in its group, from 1, in ascending order of columns that tell rows apart.

    Rows are dealt to tasks by ranges of group and order together, so that a large group spans as many tasks as it needs; each
    task numbers its share, and the shares' sizes, one row per group and task, are summed up before them. The deal is drawn
    from a sample, so it is written down before it is counted.
    """
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    sizes = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return local.join(offsets, same).withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint")).drop("_part", "_local", "_size", "_p", "_before", *[f"_g{i}" for i in range(len(group))])


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with `previous` and `next`, the value of the rows before and after in the group, by number instead of a window."""
    rows = cut(numbered(df, group, order, "_n"))
    at = lambda shift, name: rows.select(*group, (F.col("_n") + shift).alias("_n"), F.col(value).alias(name))
    keys = [*group, "_n"]
    return rows.join(at(1, "previous"), keys, "left").join(at(-1, "next"), keys, "left").drop("_n")


def best(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread: Column, parts: int = 64) -> DataFrame:
    """The n first rows of every group by an order, with `rank`: each part of a group, by a hash of `spread`, is cut to n before
    the survivors are ranked together."""
    first = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    near = first.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col("rank") <= n).drop("_part")
