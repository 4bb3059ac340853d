"""Audits and constraints of datasets: leakage, validators, traceability, gold, manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leakage(rows: DataFrame, key: str, split: str, single: Sequence[str], several: Sequence[str]) -> DataFrame:
    """(kind, value, splits, records) of values that stand in more than one split: of single-valued columns and of arrays. Pairs of
    value and split are combined map-side, so a value with a third of all records costs a row a task and split."""
    parts = [rows.select(F.lit(c).alias("kind"), F.col(c).alias("value"), F.col(split).alias("split"), F.col(key).alias("key")) for c in single]
    parts += [rows.select(F.lit(c).alias("kind"), F.explode(F.array_distinct(c)).alias("value"), F.col(split).alias("split"), F.col(key).alias("key")) for c in several]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    per = union.where("value is not null and split is not null").groupBy("kind", "value", "split").agg(F.count("*").alias("n"))
    return per.groupBy("kind", "value").agg(F.count("*").alias("splits"), F.sum("n").alias("records")).where("splits > 1")


def case_problems() -> Mapping[str, Column]:
    """What an evaluation case may break: authorisation, papers for its level, no training on tests, and what must be there."""
    papers = F.size(F.filter(F.coalesce("paper_ids", F.array().cast("array<string>")), lambda p: p.isNotNull()))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return {
        "unauthorized": F.coalesce(F.col("authorization_status") == "unauthorized", F.lit(True)), "paper_missing": F.col("difficulty").isin("L2", "L3", "L4", "L5") & (papers == 0), "papers_too_few": F.col("difficulty").isin("L4", "L5") & (papers < 2),
        "test_for_training": (F.lower(F.trim("split")) == "test") & F.col("usable_for_training"), "prompt_missing": blank("prompt"), "source_missing": blank("source_id"),
    }


def sample_problems() -> Mapping[str, Column]:
    """What a training sample may break: exactly one target or one whole pair, and consent where and only where it is private."""
    target, chosen, rejected = (F.col(c).isNotNull() for c in ("sft_target", "chosen", "rejected"))
    private = F.coalesce(F.col("privacy") == "private_authorized", F.lit(False))
    return {
        "targets": target == (chosen & rejected), "half_a_pair": chosen != rejected, "consent_missing": private & (F.coalesce("consent_id", F.lit("")) == ""), "not_anonymised": private & ~F.coalesce("anonymized", F.lit(False)),
        "consent_not_asked_for": ~private & F.col("consent_id").isNotNull(),
    }


def violations(rows: DataFrame, key: str, problems: Mapping[str, Column]) -> DataFrame:
    """(key, problems) of the rows that break any rule; a rule over nulls isn't broken."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in problems.items()]))
    return rows.select(key, found.alias("problems")).where(F.size("problems") > 0)


def traceable(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows have all of these columns filled, of how many; an empty table is wholly traceable."""
    full = F.lit(True)
    for c in columns:
        full = full & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return rows.agg(F.count("*").alias("rows"), F.count_if(full).alias("traceable")).withColumn("rate", F.coalesce(F.try_divide("traceable", "rows"), F.lit(1.0)))


def consensus_gold(answers: DataFrame) -> DataFrame:
    """(item, kind, answer) of items whose first two answers (item, place, kind, answer) are of the same kind, not unanswerable, the
    first one not empty."""
    first = answers.where("place <= 2").groupBy("item").agg(F.count("*").alias("n"), F.min_by("kind", "place").alias("kind"), F.max_by("kind", "place").alias("other"), F.min_by("answer", "place").alias("answer"))
    return first.where("n = 2 and kind = other and kind <> 'unanswerable' and coalesce(trim(answer), '') <> ''").select("item", "kind", "answer")


def manifest(rows: DataFrame, group: str, key: str, columns: Sequence[str]) -> DataFrame:
    """(group, rows, sha256): a hash of each group's rows that doesn't depend on their order: the sum of the rows' own hashes, which is
    combined map-side, hashed once more with their number."""
    row = F.sha2(F.concat_ws("\x1f", key, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = [F.sum(p).cast("string").alias(f"s{i}") for i, p in enumerate(part)]
    s = rows.groupBy(group).agg(F.count("*").alias("rows"), *sums)
    return s.select(group, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[f"s{i}" for i in range(5)]), 256).alias("sha256"))
