"""Joins, sets, grouped measures and ranks, each over tables and columns that the caller names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rate(flag: Column) -> Column:
    """The share of true among the known; null where nothing is known."""
    return F.try_divide(F.count_if(flag).cast("double"), F.count(flag))


def totals_by_role(usage: DataFrame, key: str, role: Column, amount: str, roles: Sequence[str]) -> DataFrame:
    """(key, roles..., total): the summed amount of each named role, 0 where there is none, and of all of them; other roles count
    for nothing."""
    part = [F.coalesce(F.sum(F.when(role == r, F.col(amount))), F.lit(0)).cast("bigint").alias(r) for r in roles]
    rows = usage.groupBy(key).agg(*part)
    return rows.withColumn("total", sum((F.col(r) for r in roles), F.lit(0)).cast("bigint"))


def slices(rows: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """Measures over several groupings in one pass; a column that a grouping leaves out is null, and all_<column> tells so."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    flags = [F.grouping(c).cast("int").alias(f"all_{c}") for c in columns]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*measures, *flags)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(items, observed, kappa) of two raters' labels: agreement beyond what their own frequencies give; with nothing beyond, 1 if
    they always agree and else 0."""
    n = pairs.agg(F.count("*").alias("items"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    one, two = (pairs.groupBy(F.col(c).alias("label")).agg(F.count("*").alias(f"n_{c}")) for c in (a, b))
    chance = one.join(two, "label").agg(F.coalesce(F.sum(F.col(f"n_{a}").cast("double") * F.col(f"n_{b}")), F.lit(0.0)).alias("both"))
    rows = n.crossJoin(F.broadcast(chance))
    po, pe = F.col("same").cast("double") / F.col("items"), F.col("both") / F.col("items") / F.col("items")
    k = F.when(pe == 1, F.when(F.col("same") == F.col("items"), 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return rows.select("items", po.alias("observed"), k.alias("kappa"))


def majority(votes: DataFrame, key: str, label: str, least: float = 0.95) -> DataFrame:
    """(key, consistency, needs_human): the share of the most frequent label, and whether it is under the bar."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    c = counts.groupBy(key).agg((F.max("n").cast("double") / F.sum("n")).alias("consistency"))
    return c.withColumn("needs_human", F.col("consistency") < least)


def set_scores(sets: DataFrame, predicted: str, gold: str) -> list[Column]:
    """precision and recall of two arrays as sets: without predictions 1 if nothing is gold and else 0; with nothing gold, recall 1."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) == 0, F.when(F.size(g) == 0, 1.0).otherwise(0.0)).otherwise(hit / F.size(p))
    return [precision.alias("precision"), F.when(F.size(g) == 0, 1.0).otherwise(hit / F.size(g)).alias("recall")]


def weighted_rank(rows: DataFrame, group: str, key: str, rule: Column, similarity: Column, weight: float, n: int) -> DataFrame:
    """(key, group, score, rank) of the n best of each group: the rule's score against the group's greatest, and the similarity, by
    weight; a greatest of 0 leaves the rule out."""
    named = rows.select(key, group, rule.alias("rule"), similarity.alias("sim"))
    most = named.groupBy(group).agg(F.max("rule").alias("top"))
    score = weight * F.when(F.col("top") == 0, 0.0).otherwise(F.col("rule").cast("double") / F.col("top")) + (1 - weight) * F.greatest(F.lit(0.0), F.col("sim"))
    scored = named.join(most, group).select(key, group, F.round(score, 9).alias("score"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def up_to_first(log: DataFrame, key: str, order: Sequence[str], stop: Column) -> DataFrame:
    """Entries of each key up to its first stop, the stop itself with them; all of a key that never stops."""
    at = F.struct(*order)
    first = log.where(stop).groupBy(key).agg(F.min(at).alias("_stop"))
    return log.join(first, key, "left").where(F.col("_stop").isNull() | (at <= F.col("_stop"))).drop("_stop")


def sessions(log: DataFrame, key: str, time: str, order: Sequence[str], gap: str) -> DataFrame:
    """log with each entry's session, from 1: a new one begins after a longer silence."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(time).over(w)
    fresh = F.when(before.isNull() | (F.col(time) > before + F.expr(f"interval {gap}")), 1).otherwise(0)
    return log.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("bigint")).drop("_new")


def last_before(log: DataFrame, key: str, order: str, value: str, when: Column) -> DataFrame:
    """log with `previous`, the value of the latest earlier entry of the key for which `when` holds."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("previous", F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))
