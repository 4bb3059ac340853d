"""Collects the queries of the training-data operators and their SQL."""

from __future__ import annotations

from papyrine.llm import bpe, consensus, overlap, packing, pieces, quantiles, scans, splits, topn, truncation

MODULES = (topn, scans, overlap, consensus, splits, quantiles, pieces, bpe, packing, truncation)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
