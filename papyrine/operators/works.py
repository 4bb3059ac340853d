"""Scholarly records of several sources: normal forms, merge by key, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import rules as X


def work_key(doi: Column, title: Column) -> Column:
    """doi:..., or title:... where there is none; null for a work without a title."""
    bare, key = F.trim(F.lower(doi)), X.title_key(title)
    return F.when(F.coalesce(key, F.lit("")) != "", F.when(F.coalesce(bare, F.lit("")) != "", F.concat(F.lit("doi:"), bare)).otherwise(F.concat(F.lit("title:"), key)))


def merge_works(works: DataFrame, arrival: str, fields: Sequence[str]) -> DataFrame:
    """(key, title, doi, fields..., citation_count, sources, works): records that share a key as one, the first to arrive wins a
    field, blanks are filled by later ones; sources sorted, the greatest citation count. Works without a title are dropped. Each
    field is a partial aggregate, so a key with a third of all rows is combined map-side."""
    keyed = works.withColumn("key", work_key(F.col("doi"), F.col("title"))).where("key is not null")
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(arrival))).alias(c)
    return keyed.groupBy("key").agg(
        F.min_by("title", arrival).alias("title"), filled("doi"), *[filled(f) for f in fields],
        F.max("citation_count").alias("citation_count"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("works"),
    )


def ranked_works(merged: DataFrame, n: int) -> DataFrame:
    """The n most cited, then latest, then by key; no citations counts as unknown."""
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(-1)).desc()
    return merged.orderBy(unknown("citation_count"), unknown("year"), "key").limit(n)


def crossref_work(record: Column) -> Column:
    """A work from a record of a registry with list-valued titles and dated parts."""
    date = lambda k: F.get(record[k]["date-parts"], F.lit(0))
    return F.struct(
        F.lit("crossref").alias("source"), record["DOI"].alias("external_id"), F.get(record["title"], F.lit(0)).alias("title"), X.doi(record["DOI"]).alias("doi"),
        X.first_part(*[date(k) for k in ("published-print", "published-online", "published", "issued")]).alias("year"), record["is-referenced-by-count"].alias("citation_count"),
        F.trim(F.regexp_replace(F.regexp_replace(record["abstract"], "<[^>]+>", " "), r"\s+", " ")).alias("abstract"),
    )


def openalex_work(record: Column) -> Column:
    """A work from a record whose abstract is an index of words to their places."""
    placed = F.array_sort(F.flatten(F.transform(F.map_entries(record["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))))))
    return F.struct(
        F.lit("openalex").alias("source"), record["id"].alias("external_id"), record["title"].alias("title"), X.doi(record["doi"]).alias("doi"), record["publication_year"].alias("year"),
        record["cited_by_count"].alias("citation_count"), F.nullif(F.array_join(F.transform(placed, lambda p: p["word"]), " "), F.lit("")).alias("abstract"),
    )
