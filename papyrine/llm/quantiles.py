"""Percentiles from dyadic Count-sketches: mergeable, with deletions, for values of any sign and size."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import table

#: A value's code: sign, exponent and the leading bits of its fraction. Values that share a code differ by 2 ** -28 of their size.
BITS = 40
#: Rank error, as a share of the count, that a sketch is made for.
EPS = 0.01
#: Rows (odd, for a median) of each signed sketch, and buckets of a row. A node's estimate errs by about n / BUCKETS, and the
#: errors of the levels have no common sign, so that sqrt(BITS) of them add up over a descent.
ROWS, BUCKETS = 5, 1 << math.ceil(math.log2(math.sqrt(BITS) / EPS))
#: The finest level whose nodes are fewer than a sketch's cells: it is counted exactly, and the levels above are its sums.
EXACT = int(math.log2(ROWS * BUCKETS))
LEVELS = range(EXACT + 1, BITS + 1)
#: A sketch of so few codes is kept as the list of them, which is far smaller than its cells and answers alike.
SPARSE = 2048
#: Codes of a group that wait before they are added up, and groups that a task holds before it hands them on.
PENDING, HELD = 16_384, 256

_ARITHMETIC = np.random.default_rng(20_240_601).integers(0, 1 << 63, (BITS + 1, ROWS, 3), dtype=np.int64).astype(np.uint64) * 2 + 1
_SIGN_BIT = np.uint64(1 << 63)


def codes_of(values: np.ndarray) -> np.ndarray:
    """Codes in the order of the values."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    ordered = np.where(bits & _SIGN_BIT, ~bits, bits | _SIGN_BIT)
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def value_of(code: int) -> float:
    """Of the values that share a code the one with the fewest digits, the one nearest to 0."""
    low = int(code) << (64 - BITS)
    if low >> 63:
        bits = low & ~(1 << 63)
    else:
        bits = ~(low | ((1 << (64 - BITS)) - 1)) & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def place(nodes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of nodes, from the place alone: pairwise independent, by multiplication of both halves and shift."""
    a, b, c = _ARITHMETIC[level, row]
    x = np.asarray(nodes).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (x & np.uint64(0xFFFFFFFF)) * a + (x >> np.uint64(32)) * b + c
    top = mixed >> np.uint64(63 - int(math.log2(BUCKETS)))
    return (top >> np.uint64(1)).astype(np.int64), (top & np.uint64(1)).astype(np.int64) * 2 - 1


class Sketch:
    """A linear summary of weighted codes. `codes` and `weights` hold it while it is small; after that `top`, the exact counts of
    the level EXACT, and `cells`, a signed sketch of each level below."""

    def __init__(self) -> None:
        self.codes = np.empty(0, dtype=np.int64)
        self.weights = np.empty(0, dtype=np.int64)
        self.top: np.ndarray | None = None
        self.cells: np.ndarray | None = None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> Sketch:
        if self.top is None:
            codes, weights = np.concatenate([self.codes, codes]), np.concatenate([self.weights, weights])
        codes, at = np.unique(codes, return_inverse=True)
        weights = np.bincount(at, weights, len(codes)).astype(np.int64) if len(at) else weights[:0]
        codes, weights = codes[weights != 0], weights[weights != 0]
        if self.top is None and len(codes) <= SPARSE:
            self.codes, self.weights = codes, weights
            return self
        if self.top is None:
            self.codes = self.weights = np.empty(0, dtype=np.int64)
            self.top, self.cells = np.zeros(1 << EXACT, dtype=np.int64), np.zeros((len(LEVELS), ROWS, BUCKETS), dtype=np.int64)
        np.add.at(self.top, codes >> (BITS - EXACT), weights)
        nodes = codes
        for level in reversed(LEVELS):
            for row in range(ROWS):
                bucket, sign = place(nodes, level, row)
                self.cells[level - EXACT - 1, row] += np.bincount(bucket, weights * sign, BUCKETS).astype(np.int64)
            nodes, at = np.unique(nodes >> 1, return_inverse=True)
            weights = np.bincount(at, weights, len(nodes)).astype(np.int64)
        return self

    def merge(self, other: Sketch) -> Sketch:
        if other.top is None:
            return self.add(other.codes, other.weights) if len(other.codes) else self
        if self.top is None:
            codes, weights = self.codes, self.weights
            self.codes = self.weights = np.empty(0, dtype=np.int64)
            self.top, self.cells = other.top.copy(), other.cells.copy()
            return self.add(codes, weights) if len(codes) else self
        self.top += other.top
        self.cells += other.cells
        return self

    def dump(self) -> bytes:
        flat = np.concatenate([np.diff(self.codes, prepend=0), self.weights]) if self.top is None else np.concatenate([self.top, self.cells.ravel()])
        widest = max(int(np.abs(flat).max()), 1) if len(flat) else 1
        kind = next(k for k, bits in (("i1", 7), ("i2", 15), ("i4", 31), ("i8", 63)) if widest < 1 << bits)
        return (b"s" if self.top is None else b"d") + kind.encode() + zlib.compress(flat.astype(kind).tobytes(), 1)

    @staticmethod
    def load(raw: bytes) -> Sketch:
        found, flat = Sketch(), np.frombuffer(zlib.decompress(raw[3:]), dtype=raw[1:3].decode()).astype(np.int64)
        if raw[:1] == b"s":
            found.codes, found.weights = np.cumsum(flat[: len(flat) // 2]), flat[len(flat) // 2 :].copy()
        else:
            found.top, found.cells = flat[: 1 << EXACT].copy(), flat[1 << EXACT :].reshape(len(LEVELS), ROWS, BUCKETS).copy()
        return found

    def count(self) -> int:
        return int(self.weights.sum() if self.top is None else self.top.sum())

    def weight(self, node: int, level: int) -> float:
        """The estimated weight below a node: exact where nodes are counted, else the median of the rows' signed buckets."""
        if self.top is None:
            shift = BITS - level
            lo, hi = np.searchsorted(self.codes, [node << shift, (node + 1) << shift])
            return float(self.weights[lo:hi].sum())
        if level <= EXACT:
            shift = EXACT - level
            return float(self.top[node << shift : (node + 1) << shift].sum())
        found = []
        for row in range(ROWS):
            bucket, sign = place(np.array([node]), level, row)
            found.append(self.cells[level - EXACT - 1, row, bucket[0]] * sign[0])
        return float(np.median(found))

    def value(self, q: float) -> float:
        """The value of rank ceil(q * n), by descent: on each level the left child's weight decides the side."""
        rank, node = max(1, math.ceil(q * self.count())), 0
        for level in range(1, BITS + 1):
            left = max(0.0, self.weight(node * 2, level))
            node *= 2
            if rank > left:
                rank, node = rank - left, node + 1
        return value_of(node)


def _names(df: DataFrame, keys: Sequence[str]) -> tuple[Column, str]:
    """A group's keys as one string, and the schema that brings them back."""
    return F.to_json(F.struct(*keys)), ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)


def _added(held: dict[str, Sketch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(list(held), pa.string()), "sketch": pa.array([s.dump() for s in held.values()], pa.binary())})


def build(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, sketch) of values with signed integer weights, 1 where no column is named; a weight of -1 takes a value out again.

    Each task adds what it reads to one sketch a group, so a group with a third of all rows costs a sketch a task, and the
    sketches are added up by `merge`. Rows whose value is null, NaN or infinite, or whose weight is null, add nothing; a null
    key is a group of its own; repeated rows count as often as they stand, so callers drop exact duplicates first; an empty
    table gives no sketch; other columns are ignored.
    """
    name, schema = _names(df, keys)
    v = F.col(value).cast("double")
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Sketch] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def settle(k: str) -> None:
            parts = waiting.pop(k)
            held.setdefault(k, Sketch()).add(np.concatenate([c for c, _ in parts]), np.concatenate([x for _, x in parts]))

        for batch in batches:
            named = batch.column(0).dictionary_encode()
            at = named.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            codes, weights = codes_of(batch.column(1).to_numpy())[order], batch.column(2).to_numpy()[order]
            ends = np.searchsorted(at[order], np.arange(len(named.dictionary)), side="right")
            start = 0
            for k, end in zip(named.dictionary.to_pylist(), ends.tolist(), strict=True):
                parts = waiting.setdefault(k, [])
                parts.append((codes[start:end], weights[start:end]))
                if sum(len(c) for c, _ in parts) >= PENDING:
                    settle(k)
                start = end
            if len(held) + len(waiting) > HELD:
                for k in list(waiting):
                    settle(k)
                yield _added(held)
                held = {}
        for k in list(waiting):
            settle(k)
        yield _added(held)

    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))) & w.isNotNull()).select(name.alias("k"), v.alias("v"), w.alias("w"))
    return _summed(rows.mapInArrow(run, "k string, sketch binary"), keys, schema)


def _summed(parts: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Sketches (k, sketch) added up by k: first within each task, then over groups of tasks, then all."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Sketch] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held[k].merge(Sketch.load(raw)) if k in held else Sketch.load(raw)
            if len(held) > HELD:
                yield _added(held)
                held = {}
        yield _added(held)

    def group(t: pa.Table) -> pa.Table:
        total = Sketch()
        for raw in t.column("sketch").to_pylist():
            total.merge(Sketch.load(raw))
        return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.string()), "sketch": pa.array([total.dump()], pa.binary())})

    near = parts.mapInArrow(local, "k string, sketch binary").withColumn("part", F.spark_partition_id() % 16)
    half = near.groupBy("k", "part").applyInArrow(group, "k string, sketch binary")
    whole = half.groupBy("k").applyInArrow(group, "k string, sketch binary")
    return whole.select(F.from_json("k", schema).alias("k"), "sketch").select(*[F.col("k")[x].alias(x) for x in keys], "sketch")


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sketch): adds the sketches that share `keys`, of days, partitions or deletions."""
    name, schema = _names(sketches, keys)
    return _summed(sketches.select(name.alias("k"), "sketch"), keys, schema)


def percentiles(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(keys, q, n, value): the value of rank ceil(q * n) of every sketch. Its true rank is within EPS * n of that, the value
    itself within 2 ** -28. A sketch whose weights sum to 0 or less has no row. No shuffle."""
    name, schema = _names(sketches, keys)
    qs = sorted(quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Sketch.load(raw)
                n = s.count()
                rows.extend((k, q, n, s.value(q)) for q in qs if n > 0)
            k, q, n, v = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.string()), "q": pa.array(q, pa.float64()), "n": pa.array(n, pa.int64()), "value": pa.array(v, pa.float64())})

    found = sketches.select(name.alias("k"), "sketch").mapInArrow(run, "k string, q double, n bigint, value double")
    return found.select(F.from_json("k", schema).alias("k"), "q", "n", "value").select(*[F.col("k")[x].alias(x) for x in keys], "q", "n", "value")


#: A token count above the upper quartile by so many times the distance between the quartiles, all in logarithms, is absurd and
#: no measurement: about seven standard deviations of a log-normal column.
FENCE = 4.5


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system_id, metric, day, value): exact duplicates once; latencies and token counts above 0, and token counts not beyond
    the fence of their own column. Rows without a system or day don't count."""
    scores = table(spark, sf_dir, "case_scores")
    seen = [F.xxhash64(*scores.columns).alias("seen_a"), F.xxhash64(F.lit("b"), *scores.columns).alias("seen_b")]
    rows = scores.where("system_id is not null and recorded_at is not null").select("system_id", F.to_date("recorded_at").alias("day"), "latency_ms", "total_tokens", *seen).distinct()
    quartiles = F.percentile_approx(F.when(F.col("total_tokens") > 0, F.col("total_tokens")), [0.25, 0.75], 10_000)
    fence = scores.agg(quartiles.alias("q")).select((F.col("q")[1] * F.pow(F.col("q")[1] / F.col("q")[0], FENCE)).alias("fence"))
    tokens = F.when((F.col("total_tokens") > 0) & (F.col("total_tokens") <= F.col("fence")), F.col("total_tokens"))
    metrics = F.array(
        F.struct(F.lit("latency_ms").alias("metric"), F.when(F.col("latency_ms") > 0, F.col("latency_ms")).alias("value")),
        F.struct(F.lit("total_tokens").alias("metric"), tokens.alias("value")),
    )
    flat = rows.crossJoin(F.broadcast(fence)).select("system_id", "day", F.explode(metrics).alias("m"))
    return flat.select("system_id", "m.metric", "day", "m.value").where("value is not null")


QUANTILES = (0.5, 0.9, 0.95, 0.99)
_KEYS = ["system_id", "metric"]


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(measurements(spark, sf_dir), [*_KEYS, "day"], "value")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and upper percentiles per system and metric, from daily sketches that are added up."""
    return percentiles(merge(daily_sketches(spark, sf_dir), _KEYS), _KEYS, QUANTILES)


def p6_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per day, each from that day's sketch alone."""
    return percentiles(daily_sketches(spark, sf_dir), [*_KEYS, "day"], QUANTILES)


def p6_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system_id, metric, q, n, within): whether the exact rank of each percentile of p6_percentiles is within EPS of q."""
    found = p6_percentiles(spark, sf_dir).select(*_KEYS, F.struct("q", "value", "n").alias("p")).groupBy(*_KEYS).agg(F.collect_list("p").alias("ps"))
    ranked = measurements(spark, sf_dir).groupBy(*_KEYS, "value").count().join(found, _KEYS).select(*_KEYS, "value", "count", F.explode("ps").alias("p"))
    below, upto = F.sum(F.when(F.col("value") < F.col("p.value"), F.col("count")).otherwise(0)), F.sum(F.when(F.col("value") <= F.col("p.value"), F.col("count")).otherwise(0))
    rank, slack = F.ceil(F.col("q") * F.col("n")), F.col("n") * EPS
    got = ranked.groupBy(*_KEYS, F.col("p.q").alias("q"), F.col("p.n").alias("n")).agg(below.alias("below"), upto.alias("upto"))
    return got.select(*_KEYS, "q", "n", ((F.col("below") - slack <= rank) & (rank <= F.col("upto") + slack)).alias("within"))


QUERIES = {"p6_percentiles": p6_percentiles, "p6_daily": p6_daily, "p6_within": p6_within}
SQL = {
    "p6_within": """
with rows as (select distinct * from case_scores where system_id is not null and recorded_at is not null),
quartiles as (select quantile_disc(total_tokens, 0.25) as lo, quantile_disc(total_tokens, 0.75) as hi from case_scores where total_tokens > 0),
values_ as (
  select system_id, 'latency_ms' as metric, latency_ms as v from rows where latency_ms > 0
  union all select system_id, 'total_tokens', total_tokens from rows, quartiles where total_tokens > 0 and total_tokens <= hi * pow(hi / lo, 4.5))
select system_id, metric, cast(q as double) as q, count(*) as n, true as within
from values_ cross join (select unnest([0.5, 0.9, 0.95, 0.99]) as q) qs group by system_id, metric, q
""",
}
