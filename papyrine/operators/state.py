"""Event logs and versioned state: sequences, optimistic appends, active entries, cascades, segments, summaries, queues, graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import collapse
from papyrine.operators.windows import best, numbered
from papyrine.plans.runtime import cut


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def next_sequence(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, next): the number that the next entry of each key gets, from 1."""
    return log.groupBy(key).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).cast("bigint").alias("next"))


def accepted_appends(appends: DataFrame, keys: Sequence[str], order: str, version: str) -> DataFrame:
    """(keys, order, version, accepted): an append counts if its version is one above that of the last one that counted, from 1; a
    rejected one changes nothing. One entry's versions are folded in order."""
    rows = appends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, version))).alias("a"))
    start = F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(",").alias("out"))
    step = lambda acc, x: F.when(x[version] == acc["now"] + 1, F.struct(x[version].cast("bigint").alias("now"), F.concat(acc["out"], x[order].cast("string"), F.lit(",")).alias("out"))).otherwise(acc)
    return rows.select(*keys, F.aggregate("a", start, step, lambda acc: acc["out"]).alias("ok"), "a").select(*keys, "ok", F.inline("a")).select(*keys, order, version, F.contains("ok", F.concat(F.lit(","), F.col(order).cast("string"), F.lit(","))).alias("accepted"))


def active_entries(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last state of each entry that isn't invalidated, from a log with `invalidated`."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")
    return last.where("not invalidated")


def invalidate_sources(active: DataFrame, task: str, sources: str, gone: DataFrame) -> DataFrame:
    """active with `invalidated`: all entries of a task go if any of them cites one of the sources in gone (source)."""
    hit = active.select(task, F.explode(sources).alias("source")).join(gone.select("source").distinct(), "source", "left_semi").select(task).distinct()
    return active.join(hit.withColumn("invalidated", F.lit(True)), task, "left").withColumn("invalidated", F.coalesce("invalidated", F.lit(False)))


def segments(messages: DataFrame, existing: DataFrame, window: int, size: int) -> DataFrame:
    """(talk, id, segment) of all messages (talk, id) but the newest `window` of each talk, in the order of id.

    Existing segments (talk, segment, id) stay unless they hold a message that is among the newest or gone, share one with an
    earlier segment, or are too large. The last of them is filled up with later messages; what is left is cut into segments of
    `size`, numbered on.
    """
    rows = cut(numbered(messages.select("talk", "id"), ["talk"], ["id"], "n"))
    total = rows.groupBy("talk").agg(F.count("*").alias("all"))
    old = cut(rows.join(total, "talk").where(F.col("n") <= F.col("all") - window).select("talk", "id", "n"))
    held = existing.join(old, ["talk", "id"], "left").withColumn("first", F.min("segment").over(Window.partitionBy("talk", "id")))
    kept = held.groupBy("talk", "segment").agg((F.bool_and(F.col("n").isNotNull() & (F.col("segment") == F.col("first"))) & (F.count("*") <= size)).alias("ok"), F.count("*").alias("has"), F.max("n").alias("end")).where("ok")
    known = cut(existing.join(kept.select("talk", "segment"), ["talk", "segment"], "left_semi").select("talk", "id", "segment"))
    tail = kept.groupBy("talk").agg(F.max_by(F.struct("segment", "has", "end"), "segment").alias("t")).select("talk", "t.*")
    free = old.join(known.select("talk", "id"), ["talk", "id"], "left_anti").join(tail, "talk", "left")
    later = F.coalesce(F.col("n") > F.col("end"), F.lit(False))
    marked = cut(numbered(free.withColumn("later", later), ["talk", "later"], ["n"], "k"))
    fills = F.col("later") & (F.col("k") <= size - F.col("has"))
    fresh = numbered(cut(marked.where(~F.coalesce(fills, F.lit(False))).select("talk", "id", "n", "segment")), ["talk"], ["n"], "m")
    new = fresh.select("talk", "id", (F.coalesce("segment", F.lit(-1)) + 1 + F.floor((F.col("m") - 1) / size)).cast("bigint").alias("segment"))
    return known.select("talk", "id", F.col("segment").cast("bigint").alias("segment")).unionByName(marked.where(fills).select("talk", "id", F.col("segment").cast("bigint").alias("segment"))).unionByName(new)


def fallback_summary(messages: DataFrame, covered: DataFrame, n: int = 3, width: int = 240) -> DataFrame:
    """(talk, topics, decisions): the last lines of the user and of others that no summary covers, in order, each once; messages
    (talk, id, role, text), covered (id)."""
    rows = messages.join(covered.select("id").distinct(), "id", "left_anti").select("talk", "id", (F.col("role") == "user").alias("asks"), F.substring(collapse(F.col("text")), 1, width).alias("line")).where("line <> ''")
    last = best(rows, ["talk", "asks"], [F.col("id").desc()], n, F.col("id"))
    lines = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("id", "line")))), lambda x: x["line"]))
    return last.groupBy("talk").agg(lines(F.col("asks")).alias("topics"), lines(~F.col("asks")).alias("decisions"))


def after_failure(attempts: Column, most: Column, may_retry: Column) -> Column:
    """(status, delay, dead) of a job that failed: queued again after a doubling delay of a minute at most, or failed for good."""
    again = may_retry & (attempts <= most)
    return F.struct(F.when(again, "queued").otherwise("failed").alias("status"), F.when(again, F.least(F.pow(F.lit(2.0), attempts - 1), F.lit(60.0))).alias("delay"), (~again).alias("dead"))


def stale(jobs: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"interval {seconds} seconds")))


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one above the highest they depend on; edges (node, needs). Each round
    releases the nodes whose needs are all done, until none is left; a cycle or an unknown need is an error."""
    left, wants = cut(nodes.select("node").distinct()), cut(edges.select("node", "needs").distinct())
    done, level = None, 0
    while not left.isEmpty():
        ready = cut(left.join(wants.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle or an unknown dependency")
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready.select("node"), "node", "left_anti"))
        wants = cut(wants.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti"))
        level += 1
    return nodes.select("node").distinct().withColumn("level", F.lit(0)) if done is None else done


def cascade_delete(links: DataFrame, gone: DataFrame) -> DataFrame:
    """(item, refs, action) of everything the owners in gone (owner) link to, from links (owner, item): deleted if no live owner is
    left, else kept with fewer references."""
    marked = links.distinct().join(gone.select("owner").distinct().withColumn("gone", F.lit(True)), "owner", "left")
    s = marked.groupBy("item").agg(F.count_if(F.col("gone").isNull()).alias("refs"), F.count_if("gone").alias("lost")).where("lost > 0")
    return s.select("item", "refs", F.when(F.col("refs") == 0, "delete").otherwise("update").alias("action"))


def unique_texts(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(texts, places): each distinct trimmed text once under its SHA-256 with its first key, and the text that every row has; what
    is made of the texts is joined back by the places."""
    tidy = rows.select(F.col(key).alias("key"), F.trim(F.col(text)).alias("text")).where(F.col("text").isNotNull()).withColumn("text_id", F.sha2("text", 256))
    return tidy.groupBy("text_id").agg(F.min("text").alias("text"), F.min("key").alias("first"), F.count("*").alias("copies")), tidy.select("key", "text_id")


def latest_promotions(log: DataFrame, gates: Sequence[str]) -> DataFrame:
    """(dataset, version, state) from a log of candidates (dataset, candidate, at, action) with a boolean column a gate: promoting an
    approved candidate that passes every gate raises the version; a rollback takes the last one back. The pointer is what stays."""
    ok = F.lit(True)
    for g in gates:
        ok = ok & F.coalesce(F.col(g), F.lit(False))
    acts = log.where(((F.col("action") == "promote") & ok) | (F.col("action") == "rollback"))
    rows = acts.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("at", "candidate", "action"))).alias("a"))
    start = F.array().cast("array<string>")
    step = lambda s, x: F.when(x["action"] == "promote", F.concat(s, F.array(x["candidate"]))).otherwise(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    return rows.select("dataset", F.aggregate("a", start, step).alias("s")).select("dataset", F.size("s").cast("bigint").alias("version"), F.try_element_at("s", F.lit(-1)).alias("candidate"))
