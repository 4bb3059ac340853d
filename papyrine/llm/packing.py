"""Containers of fixed capacity filled with items: best fit over the histogram of sizes."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm.bpe import encode_column, rank_file, spread_scan
from papyrine.plans.runtime import cut
from papyrine.sources.tables import table

CAPACITY = 2048
#: Sequence lengths a container may be downsized to once it is full.
LENGTHS = (256, 512, 1024, 2048)
#: Items of a size that are numbered in one task, at most about so many; and the least number of buckets that a size is dealt to.
BUCKET_ITEMS, LEAST_BUCKETS = 100_000, 64


@dataclass
class Plan:
    """Where the items of each size go: the k-th item of a size (from 0) lies in run i with first[i] <= k < first[i + 1],
    in container base[i] + (k - first[i]) // each[i]."""

    containers: int = 0
    first: dict[int, list[int]] = field(default_factory=dict)
    base: dict[int, list[int]] = field(default_factory=dict)
    each: dict[int, list[int]] = field(default_factory=dict)


def plan_packing(counts: dict[int, int], lengths: Sequence[int] = (CAPACITY,)) -> Plan:
    """Best fit, largest sizes first, on counts instead of items.

    Containers with equal room are handled as one run, so the work depends on the number of sizes alone, not on the
    number of items. Items of a size first fill the runs with the least room that still takes them. Those that fit
    nowhere open containers of the permitted length whose cost is least, room that stays unused per item placed,
    where lengths that smaller items can still fill count as full; a longer length wins a draw.
    """
    plan = Plan()
    room: dict[int, list[list[int]]] = {}
    rooms: list[int] = []
    left = sum(s * n for s, n in counts.items())

    def put(r: int, base: int, n: int) -> None:
        if n and r:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append([base, n])

    def note(size: int, placed: int, base: int, each: int) -> None:
        plan.first.setdefault(size, []).append(placed)
        plan.base.setdefault(size, []).append(base)
        plan.each.setdefault(size, []).append(each)

    for size in sorted((s for s in counts if s > 0), reverse=True):
        n, placed = counts[size], 0
        while placed < n:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                r = rooms[i]
                base, free = room[r].pop()
                if not room[r]:
                    del room[r]
                    rooms.pop(i)
            else:
                smaller = left - size * (n - placed)
                cost = lambda c: (max(0, c % size - (smaller if smaller > 0 else 0)) / (c // size), -c)  # noqa: E731, B023
                r = min((c for c in lengths if c >= size), key=cost)
                base, free = plan.containers, -(-(n - placed) // (r // size))
                plan.containers += free
            each = min(r // size, n - placed)
            full = min(free, (n - placed) // each)
            note(size, placed, base, each)
            put(r - each * size, base, full)
            placed += full * each
            rest = free - full
            if rest and placed < n:
                last = n - placed
                note(size, placed, base + full, last)
                put(r - last * size, base + full, 1)
                placed, rest, full = n, rest - 1, full + 1
            put(r, base + full, rest)
        left -= size * n
    return plan


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, lengths: Sequence[int] = (CAPACITY,)) -> DataFrame:
    """(key, piece, n_tokens, container_id): every item in a container of `capacity`; an item above it is split into
    full containers and a rest, everything else stays whole.

    An item of size 0 or null takes no room and gets a null container. Keys should be unique: rows that repeat one are
    items of their own. Only the histogram of sizes, at most `capacity` numbers, reaches the driver. Items are numbered
    within their size by bucket and offset, so that a size with a third of all items is no single task, and find
    their container in a table whose size depends on the capacity alone. Order within a size is by key.
    """
    spark = items.sparkSession
    if max(lengths) != capacity:
        raise ValueError("the greatest length must be the capacity")
    n = F.col("n")
    sized = items.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n"))
    parts = sized.where(n > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))))
    parts = parts.select("k", "piece", F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("int").alias("n"))
    histogram = {r[0]: r[1] for r in parts.groupBy("n").count().collect()}
    plan = plan_packing(histogram, lengths)
    buckets = max(LEAST_BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ITEMS))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("k", "piece"), F.lit(buckets)))
    counts = cut(parts.groupBy("bucket", "n").count())
    offsets = counts.select("bucket", "n", (F.sum("count").over(Window.partitionBy("n").orderBy("bucket")) - F.col("count")).alias("offset"))
    shared = spark.sparkContext.broadcast({s: tuple(np.array(x[s], dtype=np.int64) for x in (plan.first, plan.base, plan.each)) for s in plan.first})
    kind = dict(items.dtypes)[key]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.zeros(len(pdf), dtype=np.int64)
            for s, rows in pdf.groupby("n").indices.items():
                first, base, each = shared.value[int(s)]
                rank = pdf["rank"].to_numpy()[rows]
                i = np.searchsorted(first, rank, side="right") - 1
                at[rows] = base[i] + (rank - first[i]) // each[i]
            yield pd.DataFrame({"k": pdf["k"], "piece": pdf["piece"], "n_tokens": pdf["n"], "container_id": at})

    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "n").orderBy("k", "piece")) - 1)
    ranked = ranked.join(offsets, ["bucket", "n"]).select("k", "piece", "n", (F.col("r") + F.col("offset")).cast("bigint").alias("rank"))
    placed = ranked.mapInPandas(place, f"k {kind}, piece int, n_tokens int, container_id bigint")
    none = sized.where("n is null or n <= 0").select("k", F.lit(0).alias("piece"), F.col("n").cast("int").alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(none).withColumnRenamed("k", key)


def container_report(packed: DataFrame, capacity: int = CAPACITY, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """(container_id, items, used, room, length): each container's content and the least permitted length it can be
    downsized to."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("used"))
    length = F.lit(capacity)
    for c in sorted(lengths, reverse=True):
        length = F.when(F.col("used") <= c, c).otherwise(length)
    return used.select("container_id", "items", "used", (F.lit(capacity) - F.col("used")).alias("room"), length.alias("length"))


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(encode_column(spread_scan(documents, "doc_id"), "doc_id", "text", rank_file(), sizes_only=True))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of CAPACITY tokens alone, which TESTDATA.md asks for."""
    return pack(token_sizes(spark, sf_dir), "doc_id", "n_tokens")


def p9_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_id, items, used, room, length): containers opened at whichever of LENGTHS costs least, filled together and
    downsized to the least length that holds what they got; room is what is left of that length."""
    report = container_report(pack(token_sizes(spark, sf_dir), "doc_id", "n_tokens", lengths=LENGTHS))
    return report.withColumn("room", F.col("length") - F.col("used"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, tokens, share of room left over, and the same once containers are downsized."""
    report = container_report(p9_containers(spark, sf_dir))
    total, down = F.count("*") * CAPACITY, F.sum("length")
    return report.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("room") / total).alias("room_share"), ((down - F.sum("used")) / down).alias("room_share_downsized"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lengths, documents, fits, conserved, whole, placed) for one length and for LENGTHS: no container above the capacity; every
    document's tokens all in containers; only documents above the capacity in pieces; and a container wherever there are tokens."""
    sizes = token_sizes(spark, sf_dir)
    rows = None
    for lengths in ((CAPACITY,), LENGTHS):
        packed = cut(pack(sizes, "doc_id", "n_tokens", lengths=lengths))
        fits = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.coalesce(F.max("used") <= CAPACITY, F.lit(True)).alias("fits"))
        per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count("container_id").alias("held"))
        per = per.join(sizes.withColumnRenamed("n_tokens", "n"), "doc_id")
        n, all_ = F.coalesce("n", F.lit(0)), F.bool_and
        checks = per.agg(F.count("*").alias("documents"), all_(F.coalesce("got", F.lit(0)) == n).alias("conserved"), all_((F.col("pieces") == 1) | (n > CAPACITY)).alias("whole"), all_((F.col("held") == F.col("pieces")) == (n > 0)).alias("placed"))
        row = checks.crossJoin(fits).select(F.lit(len(lengths)).alias("lengths"), "documents", "fits", "conserved", "whole", "placed")
        rows = row if rows is None else rows.unionByName(row)
    return rows


QUERIES = {"p9_containers": p9_containers, "p9_variable": p9_variable, "p9_fill": p9_fill, "p9_invariants": p9_invariants}
SQL = {
    "p9_invariants": "select lengths, count(*) as documents, true as fits, true as conserved, true as whole, true as placed from documents cross join (select unnest([1, 4]) as lengths) l group by lengths",
}
