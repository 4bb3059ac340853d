"""Arrow-batched functions for what Catalyst has no expression for: they take whole columns and work in numpy where they can."""

from __future__ import annotations

import hashlib
import random
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.text import retrieval_terms

DIMENSIONS = 1024


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility form in folded case; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.DoubleType())
def title_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The greatest of three measures of two titles: matching blocks, the same without spaces, and shared words. Pairs that repeat in
    a batch are judged once. Null with a null, 0 with an empty title."""
    pairs = pd.DataFrame({"l": left, "r": right})
    distinct = pairs.dropna().drop_duplicates()
    blocks = [SequenceMatcher(None, a, b).ratio() for a, b in distinct.itertuples(index=False)]
    tight = [SequenceMatcher(None, a, b).ratio() for a, b in zip(distinct["l"].str.replace(" ", ""), distinct["r"].str.replace(" ", ""), strict=True)]
    sets = [(frozenset(a.split()), frozenset(b.split())) for a, b in distinct.itertuples(index=False)]
    shared = [len(a & b) / max(1, len(a | b)) for a, b in sets]
    full = np.array([bool(a) and bool(b) for a, b in distinct.itertuples(index=False)], dtype=bool)
    distinct = distinct.assign(s=np.where(full, np.max([blocks, tight, shared], axis=0), 0.0) if len(distinct) else [])
    return pairs.merge(distinct, how="left", on=["l", "r"])["s"].astype("float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _embedded(terms: pd.Series) -> pd.Series:
    known = pd.unique(np.concatenate([t for t in terms if t is not None and len(t)] or [np.empty(0, dtype=object)]))
    raw = np.array([list(hashlib.blake2b(t.encode(), digest_size=8).digest()) for t in known], dtype=np.uint64).reshape(len(known), 8)
    place = pd.Series(raw[:, 6] * 256 % DIMENSIONS + raw[:, 7], index=known, dtype="int64")  # the last bytes decide, since 1024 divides 2**16
    sign = pd.Series(np.where(raw[:, 0] % 2 == 0, 1.0, -1.0), index=known)

    def one(row: np.ndarray | None) -> np.ndarray | None:
        if row is None:
            return None
        seen, counts = np.unique(np.asarray(row, dtype=object), return_counts=True) if len(row) else (np.empty(0, dtype=object), np.empty(0))
        vector = np.bincount(place.reindex(seen).to_numpy(dtype="int64"), sign.reindex(seen).to_numpy() * (1 + np.log(counts)), DIMENSIONS) if len(seen) else np.zeros(DIMENSIONS)
        return vector / (np.linalg.norm(vector) or 1.0)

    return terms.map(one)


def with_hash_embedding(df: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    """df with each text's unit vector: each term adds 1 + ln(count) at a hashed place, the sign by the hash's first byte. The terms
    are made in the JVM, as a column of their own that is used twice, so that they are not made again inside the function's
    arguments; null stays null, a text without terms is all zeros."""
    terms = df.withColumn("_terms", retrieval_terms(F.col(text)))
    return terms.withColumn(name, F.when(F.size("_terms") >= 0, _embedded("_terms"))).drop("_terms")


def percentile(values: np.ndarray | list[float], q: float) -> float:
    """Linear interpolation between the closest ranks."""
    return float(np.quantile(np.asarray(values, dtype=float), q, method="linear"))


def draws(n: int, seed: int, resamples: int) -> np.ndarray:
    """The rows of each resample, by the generator that the golden values were made with: a row of n places a resample."""
    source = random.Random(seed)
    return np.fromiter((source.randrange(n) for _ in range(n * resamples)), dtype=np.int64, count=n * resamples).reshape(resamples, n)


def interval(statistics_: np.ndarray, alpha: float) -> tuple[float, float]:
    return percentile(statistics_, alpha), percentile(statistics_, 1 - alpha)


def mean_of(rows: np.ndarray) -> np.ndarray:
    return rows.mean(axis=-1)


def bootstrap(values: list[float], seed: int, resamples: int = 2000, alpha: float = 0.025, statistic: Callable = mean_of) -> tuple[float, float]:
    """Seeded percentile interval of a statistic, alpha on either side."""
    v = np.asarray(values, dtype=float)
    return interval(statistic(v[draws(len(v), seed, resamples)]), alpha)


def paired_bootstrap(candidate: list[float], baseline: list[float], seed: int, resamples: int = 2000, alpha: float = 0.025, statistic: Callable = mean_of) -> tuple[float, float, float]:
    """(difference, low, high) of a statistic of two arms whose rows are drawn together."""
    a, b = np.asarray(candidate, dtype=float), np.asarray(baseline, dtype=float)
    at = draws(len(a), seed, resamples)
    return (float(statistic(a) - statistic(b)), *interval(statistic(a[at]) - statistic(b[at]), alpha))


def bootstrap_by(df: DataFrame, group: str, order: str, value: str, seed: int = 17, resamples: int = 2000) -> DataFrame:
    """(group, lo, hi) by seeded resampling of each group's values in their order: for evaluation tables, whose groups
    are a run's cases. The hash-indexed form in the query registry is the one for large groups."""
    kind = dict(df.dtypes)[group]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bootstrap(pdf.sort_values(order)[value].tolist(), seed, resamples)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "lo": [lo], "hi": [hi]})

    return df.where(F.col(value).isNotNull()).groupBy(group).applyInPandas(one, f"`{group}` {kind}, lo double, hi double")
