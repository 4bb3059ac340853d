"""Ranked evidence retrieval: exact, BM25 and vector channels, rank fusion, lexical rerank and expansions.

A corpus is a DataFrame (id, text, ...) that is already cut to the scope of the question: statistics are those of the
scope, so a filter must come before these operators, never after. The query's terms are literals; postings are cut to
them before anything is exploded, so a shuffle carries matching terms only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.text import alternation, query_terms, retrieval_terms
from papyrine.operators.windows import best, numbered
from papyrine.plans.runtime import cut

K1, B = 1.5, 0.75
CANDIDATES, FINAL, RRF_K = 30, 8, 60
DIMENSIONS = 64
#: What a section hint in one language stands for in the other (fixed values).
SECTION_WORDS = {"实验": "experiments experiment", "方法": "methods methodology method", "结果": "results result findings", "引言": "introduction", "结论": "conclusion conclusions", "讨论": "discussion", "摘要": "abstract"}


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n best rows, by score and then key; planned as TakeOrderedAndProject."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(n)


def exact(corpus: DataFrame, query: str, n: int = CANDIDATES) -> DataFrame:
    """(id, score): matches of any longer query term anywhere in the text, inside words too."""
    terms = [t for t in dict.fromkeys(query_terms(query)) if len(t) > 1]
    if not terms:
        return corpus.select("id", F.lit(0).cast("bigint").alias("score")).limit(0)
    hits = F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({alternation(terms)})"), F.lit(1))).cast("bigint")
    return top(corpus.select("id", hits.alias("score")).where("score > 0"), "score", "id", n)


def term_postings(corpus: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, dl, term, tf) of the query's terms only; dl counts all terms of the text."""
    wanted = F.array(*[F.lit(t) for t in terms])
    with_terms = corpus.select("id", retrieval_terms(F.col("text")).alias("terms"))
    cut = with_terms.select("id", F.size("terms").alias("dl"), F.filter("terms", lambda t: F.array_contains(wanted, t)).alias("hit"))
    return cut.select("id", "dl", F.explode("hit").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(corpus: DataFrame, query: str, n: int | None = CANDIDATES) -> DataFrame:
    """(id, score), rounded to 9 digits so that ties break alike everywhere. A term that the query repeats counts as
    often; statistics are the corpus's own."""
    weights = Counter(query_terms(query))
    postings = term_postings(corpus, list(weights))
    stats = corpus.select(F.size(retrieval_terms(F.col("text"))).alias("dl")).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.element_at(F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, float(w))]), F.col("term"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.greatest(F.col("dl"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1.0))
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = postings.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return scored if n is None else top(scored, "score", "id", n)


def _bucket(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % DIMENSIONS


def _sign(term: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(term), 9, 2), 16, 10).cast("bigint") % 2 == 0, 1.0).otherwise(-1.0)


def hash_embedding(corpus: DataFrame) -> DataFrame:
    """(id, dim, v): sparse hash embedding, 1 + ln(count) of each term at a hashed place with a hashed sign."""
    tf = corpus.select("id", F.explode(retrieval_terms(F.col("text"))).alias("term")).groupBy("id", "term").count()
    return tf.groupBy("id", _bucket(F.col("term")).alias("dim")).agg(F.round(F.sum(_sign(F.col("term")) * (1 + F.log("count"))), 9).alias("v"))


def vector(corpus: DataFrame, query: str, n: int = CANDIDATES) -> DataFrame:
    """(id, score): cosine of hash embeddings, positive ones only."""
    spark = corpus.sparkSession
    asked = hash_embedding(spark.createDataFrame([(0, query)], "id int, text string")).select("dim", F.col("v").alias("q"))
    qnorm = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    joined = hash_embedding(corpus).join(F.broadcast(asked), "dim", "left").groupBy("id").agg(F.sum(F.col("v") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    scored = joined.crossJoin(F.broadcast(qnorm)).select("id", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 9).alias("score"))
    return top(scored.where("score > 0"), "score", "id", n)


def nearest(queries: DataFrame, rows: DataFrame, n: int = CANDIDATES, block: int = 2048, query_block: int = 512) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query (query_id, embedding) the n rows (vec_id, embedding) with the best
    positive cosine, rounded to 6 digits, then by vec_id. Blocks of queries meet blocks of rows, each pair of blocks gives its own n best
    a query, and those are merged. Vectors that are null, or of another length than the query, match nothing."""

    def blocks(df: DataFrame, key: str, ids: str, vectors: str, size: int) -> DataFrame:
        """Rows dealt to blocks of about `size` by partition and place in it, so that no key makes a block large."""
        dealt = df.where("embedding is not null").select(F.col(key), "embedding", F.spark_partition_id().alias("part"), F.floor(F.monotonically_increasing_id() % (1 << 33) / size).alias("no"))
        return dealt.groupBy("part", "no").agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col("embedding").alias("v"))).alias("b")).select(F.transform("b", lambda x: x["id"]).alias(ids), F.transform("b", lambda x: x["v"]).alias(vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield from _best_of(r.qids, r.qs, r.ids, r.vs, n)

    pairs = blocks(queries, "query_id", "qids", "qs", query_block).crossJoin(blocks(rows, "vec_id", "ids", "vs", block))
    found = pairs.mapInPandas(run, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def _best_of(qids: Sequence[int], qs: Sequence, ids: Sequence[int], vs: Sequence, n: int) -> Iterator[pd.DataFrame]:
    """The n best pairs of each query within two blocks, a frame for each length of vector."""

    def unit(vectors: Sequence, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([i for i, v in enumerate(vectors) if len(v) == length])
        m = np.array([vectors[i] for i in at], dtype="float64").reshape(len(at), length)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return at, m / np.where(norm == 0, np.inf, norm)

    for length in {len(q) for q in qs}:
        (qat, q), (at, v) = unit(qs, length), unit(vs, length)
        if not len(at):
            continue
        own, scores = np.asarray(ids)[at], np.round(q @ v.T, 6)
        for k, row in enumerate(scores):
            best = np.lexsort((own, -row))[:n]
            best = best[row[best] > 0]
            yield pd.DataFrame({"query_id": np.full(len(best), qids[qat[k]], dtype="int64"), "vec_id": own[best].astype("int64"), "score": row[best]})


def rrf(channels: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of short ranked lists."""
    w = Window.orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = [c.select("id", F.row_number().over(w).alias("rank")) for c in channels]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    return union.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def lexical(query: str, text: Column, terms: Column) -> Column:
    """Overlap of term counts with the query, and a bonus where the text holds the query itself. `terms` are the text's
    terms, computed once by the caller."""
    asked = Counter(query_terms(query))
    overlap = sum((F.least(F.size(F.filter(terms, _equals(term))), F.lit(c)) for term, c in asked.items()), F.lit(0))
    return F.round(overlap / max(1, sum(asked.values())) + F.when(F.contains(F.lower(text), F.lit(query.lower())), 0.25).otherwise(0.0), 9)


def _equals(term: str):
    return lambda t: t == F.lit(term)


def _place(term: str) -> tuple[int, float]:
    digest = hashlib.md5(term.encode()).digest()
    return int.from_bytes(digest[:4], "big") % DIMENSIONS, 1.0 if digest[4] % 2 == 0 else -1.0


def _vector(terms: Sequence[str], places: dict[str, tuple[int, float]]) -> tuple[np.ndarray, float]:
    """A text's hash embedding, and the length of its vector of term counts."""
    counts = Counter(terms)
    at = np.empty(len(counts), dtype=np.int64)
    weights = np.empty(len(counts))
    for i, (t, n) in enumerate(counts.items()):
        if t not in places:
            places[t] = _place(t)
        at[i], weights[i] = places[t][0], places[t][1] * (1 + np.log(n))
    return np.round(np.bincount(at, weights, DIMENSIONS), 9), float(np.sqrt(sum(n * n for n in counts.values())))


def closeness(query: str):
    """A batch function over arrays of terms: (cosine of hash embeddings, cosine of term counts) with the query, 0 where there is
    none. It stands for vectors that an index would hold."""
    asked = query_terms(query)
    wanted = Counter(asked)
    q, length = _vector(asked, {})
    norm = float(np.sqrt((q * q).sum()))

    @F.pandas_udf(T.StructType([T.StructField("dense", T.DoubleType()), T.StructField("sparse", T.DoubleType())]))
    def judge(terms: pd.Series) -> pd.DataFrame:
        places: dict[str, tuple[int, float]] = {}
        rows = []
        for row in terms:
            row = [] if row is None else list(row)
            v, own = _vector(row, places)
            size = float(np.sqrt((v * v).sum())) * norm
            shared = sum(n * wanted[t] for t, n in Counter(t for t in row if t in wanted).items())
            rows.append((float(v @ q) / size if size else 0.0, shared / (own * length) if own and length else 0.0))
        return pd.DataFrame(rows, columns=["dense", "sparse"])

    return judge


def signals(corpus: DataFrame, query: str, keys: Sequence[str] = ()) -> DataFrame:
    """(id, keys, dl, tf, exact, dense, sparse, phrase): all that ranking needs of each text, from one scan in which its terms are
    made once: length, counts of the query's terms, matches, closeness, and whether it holds the query. Rows are narrow, so
    exact copies are dropped and the rows are written down without their texts."""
    asked = list(Counter(query_terms(query)))
    longer = [t for t in asked if len(t) > 1]
    hits = F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({alternation(longer)})"), F.lit(1))).cast("bigint") if longer else F.lit(0).cast("bigint")
    rows = corpus.select("id", *keys, hits.alias("exact"), F.contains(F.lower("text"), F.lit(query.lower())).alias("phrase"), retrieval_terms(F.col("text")).alias("terms"))
    rows = rows.withColumns({"dl": F.size("terms"), "tf": F.array(*[F.size(F.filter("terms", _equals(t))) for t in asked]) if asked else F.array().cast("array<int>"), "c": closeness(query)("terms")})
    return cut(rows.select("id", *keys, "dl", "tf", "exact", F.round("c.dense", 9).alias("dense"), F.round("c.sparse", 9).alias("sparse"), "phrase").distinct())


def bm25_signals(rows: DataFrame, query: str, group: str | None = None) -> DataFrame:
    """rows of `signals` with `bm25`, by the statistics of the scope, or of each group in it."""
    weights = Counter(query_terms(query))
    by = [group] if group else []
    found = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(weights))]
    stats = rows.groupBy(*by).agg(F.count("*").alias("docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *found)
    joined = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))
    part = F.lit(0.0)
    for i, w in enumerate(weights.values()):
        df, tf = F.col(f"df{i}"), F.col("tf")[i]
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        part = part + float(w) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.col("avgdl")))
    return joined.select(*rows.columns, F.round(part, 9).alias("bm25"))


def lexical_signals(query: str) -> Column:
    """The lexical score of a row of `signals`."""
    asked = Counter(query_terms(query))
    overlap = sum((F.least(F.col("tf")[i], F.lit(c)) for i, c in enumerate(asked.values())), F.lit(0))
    return F.round(overlap / max(1, sum(asked.values())) + F.when(F.col("phrase"), 0.25).otherwise(0.0), 9)


def ranked(rows: DataFrame, query: str, channels: Sequence[str] = ("exact", "bm25", "dense"), limit: int = FINAL) -> DataFrame:
    """(id, score, rank): of rows of `bm25_signals` the best by each channel, fused, reranked lexically and cut, then ordered by
    both scores together. Only lists of CANDIDATES rows meet."""
    keep = rows.withColumn("lex", lexical_signals(query))
    lists = [top(keep.select("id", F.col(c).alias("score"), "lex").where("score > 0"), "score", "id", CANDIDATES) for c in channels]
    w = Window.orderBy(F.col("score").desc(), F.col("id").asc())
    union = None
    for x in lists:
        one = x.select("id", "lex", F.row_number().over(w).alias("r"))
        union = one if union is None else union.unionByName(one)
    fused = union.groupBy("id").agg(F.round(F.sum(1 / (RRF_K + F.col("r"))), 9).alias("fused"), F.max("lex").alias("lex"))
    order = Window.orderBy(F.col("lex").desc(), F.col("fused").desc(), F.col("id").asc())
    kept = fused.withColumn("r", F.row_number().over(order)).where(F.col("r") <= min(FINAL, limit)).withColumn("score", F.round(F.col("fused") + F.col("lex"), 9))
    return kept.select("id", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("fused").desc(), F.col("id").asc())).alias("rank"))


def hybrid(corpus: DataFrame, query: str, limit: int = FINAL) -> DataFrame:
    """(id, score, rank) from one scan of the corpus: exact, BM25 and vector channels, fused and reranked."""
    return ranked(bm25_signals(signals(corpus, query), query), query, limit=limit)


def pages(corpus: DataFrame, query: str, limit: int = FINAL) -> DataFrame:
    """The same over pages, with the cosine of term counts as third channel."""
    return ranked(bm25_signals(signals(corpus, query), query), query, ("exact", "sparse", "bm25"), limit)


def balanced(corpus: DataFrame, query: str, files: DataFrame, total: int = FINAL) -> DataFrame:
    """(file_id, id, score, rank): the best of every file in scope by its own statistics, max(1, total // files) of each, files in
    order, `total` in all; a file without a match has one row without an id."""
    scope = cut(files.select("file_id").distinct())
    each = max(1, total // max(1, scope.count()))
    rows = bm25_signals(signals(corpus.join(scope, "file_id", "left_semi"), query, ["file_id"]), query, "file_id")
    found = best(rows.where("bm25 > 0"), ["file_id"], [F.col("bm25").desc(), F.col("id").asc()], each, F.col("id"))
    first = found.orderBy("file_id", "rank").limit(total).select("file_id", "id", F.col("bm25").alias("score"), "rank")
    none = scope.join(found.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("rank"))
    return first.unionByName(none)


def expand_section(hits: DataFrame, corpus: DataFrame, limit: int = FINAL) -> DataFrame:
    """(id, score, rank): all chunks of the best hit's section by page and id, those that weren't hit a hundredth below it, then the
    other hits, cut at the limit. hits (id, score, rank), corpus (id, file_id, section_path, page_start)."""
    home = hits.where("rank = 1").join(corpus, "id").select("file_id", "section_path", F.greatest(F.lit(0.0), F.col("score") - 0.01).alias("near"))
    inside = corpus.join(F.broadcast(home), ["file_id", "section_path"]).orderBy("page_start", "id").limit(limit).select("id", "page_start", "near")
    scored = inside.join(hits.select("id", "score"), "id", "left").select("id", F.coalesce("score", "near").alias("score"), F.lit(0).alias("late"), F.coalesce("page_start", F.lit(-1)).alias("at"))
    rest = hits.join(inside.select("id"), "id", "left_anti").select("id", "score", F.lit(1).alias("late"), F.col("rank").alias("at"))
    order = Window.orderBy("late", "at", "id")
    return scored.unionByName(rest).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit).select("id", "score", "rank")


def with_neighbours(hits: DataFrame, corpus: DataFrame, limit: int = FINAL) -> DataFrame:
    """(id, score, rank): hits with the chunk before and after each in its file, in the order of the documents. Hits are taken in
    order until there are `limit` places; a neighbour that wasn't hit scores a hundredth below the best hit."""
    placed = numbered(corpus.select("file_id", "id"), ["file_id"], ["id"], "pos")
    h = hits.join(placed, "id").select("file_id", "pos", "rank", "score", "id")
    near = cut(h.select("file_id", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"), "rank").groupBy("file_id", "pos").agg(F.min("rank").alias("rank")))
    rows = placed.join(F.broadcast(near), ["file_id", "pos"]).select("file_id", "pos", "id", "rank")
    so_far = rows.groupBy("rank").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = so_far.agg(F.coalesce(F.min(F.when(F.col("all") >= limit, F.col("rank"))), F.max("rank")).alias("last"))
    top_score = hits.agg(F.max_by("score", -F.col("rank")).alias("best"))
    kept = rows.crossJoin(F.broadcast(last)).where("rank <= last").join(hits.select("id", "score"), "id", "left").crossJoin(F.broadcast(top_score))
    final = kept.select("id", F.coalesce("score", F.greatest(F.lit(0.0), F.col("best") - 0.01)).alias("score"), F.row_number().over(Window.orderBy("file_id", "pos")).cast("bigint").alias("rank"))
    return final.where(F.col("rank") <= limit)


def coverage(chunks: DataFrame, budget: int) -> DataFrame:
    """(file_id, id, score) of chunks (file_id, section, id, size) in the order of id: all of a file whose sizes sum up to the
    budget at most; else its first, middle and last chunk and the first of every section in any case, and then, in order, each
    that still fits. Places and sizes alone are folded, never texts; each file's order is read once."""
    rows = cut(numbered(chunks.select("file_id", "section", "id", "size"), ["file_id"], ["id"], "n"))
    per = rows.groupBy("file_id").agg(F.count("*").alias("all"), F.sum("size").alias("total"))
    first = rows.groupBy("file_id", "section").agg(F.min("n").alias("n")).select("file_id", "n").withColumn("head", F.lit(True))
    marked = rows.join(per, "file_id").join(first, ["file_id", "n"], "left").withColumn("must", (F.col("n") == 1) | (F.col("n") == F.col("all")) | (F.col("n") == F.floor(F.col("all") / 2) + 1) | F.coalesce("head", F.lit(False)))
    whole = marked.where(F.col("total") <= budget).select("file_id", "id", "n")
    large = cut(marked.where(F.col("total") > budget).select("file_id", "id", "n", "size", "must"))
    used = large.groupBy("file_id").agg(F.coalesce(F.sum(F.when(F.col("must"), F.col("size"))), F.lit(0)).alias("used"), F.array_sort(F.collect_list(F.when(~F.col("must") & (F.col("size") <= budget), F.struct("n", "size")))).alias("rest"))
    start = F.struct(F.col("used").cast("bigint").alias("used"), F.lit("").alias("out"))
    step = lambda a, x: F.when(a["used"] + x["size"] <= budget, F.struct((a["used"] + x["size"]).cast("bigint").alias("used"), F.concat(a["out"], F.lit(","), x["n"].cast("string")).alias("out"))).otherwise(a)
    taken = used.select("file_id", F.explode(F.transform(F.filter(F.split(F.aggregate("rest", start, step, lambda a: a["out"]), ","), lambda x: x != ""), lambda x: x.cast("bigint"))).alias("n"))
    picked = large.where("must").select("file_id", "id", "n").unionByName(large.join(taken, ["file_id", "n"], "left_semi").select("file_id", "id", "n"))
    every = cut(whole.unionByName(picked))
    place = numbered(every, ["file_id"], ["n"], "i")
    return place.select("file_id", "id", F.round(F.greatest(F.lit(0.0), 1.0 - (F.col("i") - 1) * 0.001), 6).alias("score"))


def scoped_sections(corpus: DataFrame, hint: str) -> DataFrame:
    """Chunks whose section path shares a term with the hint or the words it stands for; all chunks where none does."""
    words = query_terms(f"{hint} {SECTION_WORDS.get(hint.lower(), '')}")
    hit = F.coalesce(F.arrays_overlap(retrieval_terms(F.array_join("section_path", " ")), F.array(*[F.lit(w) for w in words])), F.lit(False)) if words else F.lit(False)
    rows = corpus.withColumn("in_scope", hit)
    some = rows.agg(F.coalesce(F.max("in_scope"), F.lit(False)).alias("some"))
    return rows.crossJoin(F.broadcast(some)).where("in_scope or not some").drop("in_scope", "some")
