"""What goes into a context: folds under budgets, related messages, cited sentences, remembered entries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import rules as X
from papyrine.functions.text import sentences


def admitted(items: DataFrame, key: str, order: str, budgets: Mapping[str, int], required: str | None = None, slots: int | None = None) -> DataFrame:
    """(key, order) of each group's items (key, order, sizes) that are admitted: required ones in any case and first, then, of the
    first `slots` others in order, each that overflows none of the budgets; one that does is skipped and the next is tried.

    The fold carries sums and a list of places, and reads one array of narrow structs a group, of items that could fit alone."""
    must = F.coalesce(F.col(required), F.lit(False)) if required else F.lit(False)
    sizes = [F.coalesce(F.col(b), F.lit(0)).cast("bigint").alias(b) for b in budgets]
    rows = items.select(key, order, *sizes, must.alias("must"))
    if slots is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key, "must").orderBy(order))).where(F.col("must") | (F.col("place") <= slots))
    alone = ~F.col("must")
    for b, most in budgets.items():
        alone = alone & (F.col(b) <= most)
    used = [F.coalesce(F.sum(F.when(F.col("must"), F.col(b))), F.lit(0)).alias(b) for b in budgets]
    per = rows.groupBy(key).agg(*used, F.array_sort(F.collect_list(F.when(alone, F.struct(order, *budgets)))).alias("rest"))
    start = F.struct(*[F.col(b).cast("bigint").alias(b) for b in budgets], F.lit("").alias("out"))

    def step(acc: Column, x: Column, i: Column) -> Column:
        fits = F.lit(True)
        for b, most in budgets.items():
            fits = fits & (acc[b] + x[b] <= most)
        taken = F.struct(*[(acc[b] + x[b]).alias(b) for b in budgets], F.concat(acc["out"], F.lit(","), i.cast("string")).alias("out"))
        return F.when(fits, taken).otherwise(acc)

    numbered = F.transform("rest", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    places = F.aggregate(numbered, start, lambda acc, p: step(acc, p["x"], p["i"]), lambda acc: acc["out"])
    chosen = F.transform(F.filter(F.split(places, ","), lambda p: p != ""), lambda p: F.get(F.col("rest"), p.cast("int"))[order])
    return per.select(key, F.explode(chosen).alias(order)).unionByName(rows.where("must").select(key, order))


def related_messages(messages: DataFrame, key: str, order: str, text: Column, terms: Column, asked: list[str], follow_up: bool, most: int = 12, characters: int = 3600, overlap: float = 0.12) -> DataFrame:
    """(key, order) of the messages that go with a question: of the last `most`, those that share enough terms with it and the last
    two, four after a follow-up; from the newest back until the next one would overflow, the newest in any case."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(asked)])
    share = F.size(F.array_intersect(q, terms)) / max(1, len(set(asked)))
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = messages.select(key, order, share.alias("share"), F.length(text).alias("size"), F.row_number().over(newest).alias("back")).where(F.col("back") <= most)
    picked = last.where((F.col("share") >= overlap) | (F.col("back") <= (4 if follow_up else 2)))
    w = Window.partitionBy(key).orderBy("back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = picked.withColumns({"used": F.sum("size").over(w), "first": F.row_number().over(newest)})
    return packed.where((F.col("used") <= characters) | (F.col("first") == 1)).select(key, order)


def remembered_messages(messages: DataFrame, key: str, order: str, terms: Column, asked: list[str], most: int = 6) -> DataFrame:
    """(key, order) of the best messages by shared terms and each one's next, in order, `most` in all."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(asked)])
    inside = Window.partitionBy(key).orderBy(order)
    rows = messages.select(key, order, F.size(F.array_intersect(q, terms)).alias("score"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), order))).withColumn("hit", (F.col("r") <= most) & (F.col("score") > 0))
    near = best.withColumn("after", F.coalesce(F.lag("hit").over(inside), F.lit(False))).where("hit or after")
    return near.withColumn("n", F.row_number().over(inside)).where(F.col("n") <= most).select(key, order)


def cited_sentences(hits: DataFrame, texts: DataFrame, question: Column, least: float = 0.5, n: int = 3) -> DataFrame:
    """(citation, id, place, coverage) of the sentences of hits (id, score) that hold enough of the question's meaningful terms: the
    n best by coverage, then the hit's score, then id and place, named C1 and on."""
    q = F.array_distinct(X.meaningful_terms(question))
    rows = texts.join(F.broadcast(hits), "id").select("id", "score", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    cover = X.ratio_at_least(F.size(F.array_intersect(q, X.meaningful_terms(F.col("sentence")))), F.size(q))
    order = [F.col("coverage").desc(), F.col("score").desc(), F.col("id"), F.col("place")]
    found = rows.select("id", "score", "place", cover.alias("coverage")).where(F.col("coverage") >= least).orderBy(*order).limit(n)
    return found.select(F.concat(F.lit("C"), F.row_number().over(Window.orderBy(*order)).cast("string")).alias("citation"), "id", F.col("place").cast("bigint").alias("place"), "coverage")


def remembered_entries(entries: DataFrame, terms: Column, closeness: Column, comparable: Column, asked: list[str], n: int) -> DataFrame:
    """(id, score) of the n best entries: twice the share of the question's terms, and the vectors' cosine where they are of the
    same space."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(asked)])
    share = F.size(F.array_intersect(q, terms)) / max(1, len(set(asked)))
    scored = entries.select("id", F.round(2 * share + F.when(comparable, closeness).otherwise(0.0), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(n)
