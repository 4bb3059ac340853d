"""Retrieval queries over the chunks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions.text import cosine, retrieval_terms
from papyrine.operators import retrieval as R
from papyrine.plans.runtime import spread_scan
from papyrine.sources.tables import table

QUERY = "calibration error of the probabilistic checkpoint"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by id, exact copies once, without those whose text is missing."""
    return table(spark, sf_dir, "chunks").where("text is not null").select(F.col("chunk_id").alias("id"), "file_id", "text", "section_path", "page_start").distinct()


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with exact copies: for what drops them once rows are narrow."""
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "file_id", "text", "section_path", "page_start")
    return spread_scan(chunks, "id").where("text is not null")


def q_terms(spark, d):
    rows = corpus(spark, d).select("id", retrieval_terms(F.col("text")).alias("t"))
    return rows.select("id", F.size("t").cast("bigint").alias("n_terms"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def q_exact(spark, d):
    return R.exact(corpus(spark, d), QUERY)


def q_exact_count(spark, d):
    low = F.lower("text")
    count = lambda t: ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("bigint")
    total = sum((count(t) for t in ("calibration", "error", "or")), F.lit(0))
    return corpus(spark, d).select("id", total.cast("bigint").alias("score")).where("score > 0")


def q_bm25(spark, d):
    return R.bm25(corpus(spark, d), QUERY)


def q_hash_embed(spark, d):
    return R.hash_embedding(corpus(spark, d)).groupBy("id").agg(F.count("*").alias("dims"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("norm2"))


def q_rrf(spark, d):
    c = corpus(spark, d)
    return R.rrf([R.exact(c, QUERY), R.bm25(c, QUERY)])


def q_rerank(spark, d):
    c = corpus(spark, d).select("id", "text", retrieval_terms(F.col("text")).alias("terms"))
    return R.top(c.select("id", R.lexical(QUERY, F.col("text"), F.col("terms")).alias("score")).where("score > 0"), "score", "id", 30)


def q_hybrid(spark, d):
    return R.hybrid(scan(spark, d), QUERY).select("id", "score", F.col("rank").cast("bigint").alias("rank"))


def q_vector_search(spark, d):
    """The 30 nearest of all vectors for each whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return R.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "embedding"))


def q_cosine(spark, d):
    """Cosine of every vector with the mean vector of its label's first member."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def q_sparse_cosine(spark, d):
    """Cosine of term counts between each chunk and its file's first chunk."""
    c = corpus(spark, d).where("file_id is not null")
    tf = c.select("file_id", "id", F.explode(retrieval_terms(F.col("text"))).alias("term")).groupBy("file_id", "id", "term").agg(F.count("*").alias("n"))
    first = c.groupBy("file_id").agg(F.min("id").alias("first"))
    base = tf.join(first, "file_id").where("id = first").select("file_id", "term", F.col("n").alias("m"))
    norms = tf.groupBy("id").agg(F.sum(F.col("n") * F.col("n")).alias("n2"))
    dot = tf.join(base, ["file_id", "term"], "left").groupBy("file_id", "id").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("dot"))
    other = base.groupBy("file_id").agg(F.sum(F.col("m") * F.col("m")).alias("m2"))
    return dot.join(norms, "id").join(other, "file_id").select("id", F.round(F.col("dot") / F.sqrt(F.col("n2").cast("double") * F.col("m2")), 6).alias("score"))


def q_ir_metrics(spark, d):
    """pass@5, recall@10 and MRR@10 of the search log: a hit is right if its chunk belongs to the query's first file."""
    h = table(spark, d, "search_hits").where("file_id is not null and score is not null and not isnan(score)").select("query_id", "hit_id", "file_id", "score").distinct()
    gold = h.groupBy("query_id").agg(F.min("file_id").alias("gold"))
    ranked = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("hit_id").asc()))).where("rank <= 10")
    first = gold.join(ranked, (gold.query_id == ranked.query_id) & (gold.gold == ranked.file_id), "left").groupBy(gold.query_id).agg(F.min("rank").alias("rank"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return first.agg(F.count("*").alias("queries"), share(F.col("rank") <= 5).alias("pass_at_5"), share(F.col("rank") <= 10).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 9).alias("mrr_at_10"))


QUERIES = {f.__name__: f for f in (q_terms, q_exact, q_exact_count, q_bm25, q_hash_embed, q_rrf, q_rerank, q_hybrid, q_vector_search, q_cosine, q_sparse_cosine, q_ir_metrics)}

_CORPUS = "corpus as (select distinct chunk_id as id, file_id, text, section_path, page_start from chunks where text is not null)"
_TERMS = r"""list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[_.-][a-z0-9]+)*'),
  flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_concat(
    list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))"""
_WITH_TERMS = f"{_CORPUS}, terms as (select id, text, {_TERMS.format('text')} as t from corpus)"
_Q = f"q as (select unnest({_TERMS.format(chr(39) + QUERY + chr(39))}) as term)"
_EXACT = "exact_all as (select id, cast(len(regexp_extract_all(lower(text), 'calibration|error|of|the|probabilistic|checkpoint')) as bigint) as score from corpus), exact as (select * from exact_all where score > 0 order by score desc, id limit 30)"
_BM25 = """stats as (select count(*) as docs, greatest(avg(len(t)), 1) as avgdl from terms),
postings as (select id, greatest(dl, 1) as dl, term, count(*) as tf from (select id, len(t) as dl, unnest(t) as term from terms) where term in (select term from q) group by all),
dfs as (select term, count(*) as df from postings group by term), qw as (select term, count(*) as w from q group by term),
bm25 as (select id, round(sum(w * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from postings join dfs using (term) join qw using (term), stats group by id having score > 0 order by score desc, id limit 30)"""
_EMBED = """tf as (select id, term, count(*) as n from (select id, unnest(t) as term from terms) group by all),
embed as (select id, cast('0x' || md5(term)[1:8] as bigint) % 64 as dim, round(sum(case when cast('0x' || md5(term)[9:10] as bigint) % 2 = 0 then 1.0 else -1.0 end * (1 + ln(n))), 9) as v from tf group by all)"""
_LEX = f"""asked as (select term, count(*) as c from q group by term),
lex as (select id, round(coalesce((select sum(least(c, len(list_filter(t, lambda x: x = term)))) from asked), 0) / (select count(*) from q)
  + case when contains(lower(text), lower('{QUERY}')) then 0.25 else 0.0 end, 9) as lex from terms)"""

SQL = {
    "q_terms": f"with {_WITH_TERMS} select id, cast(len(t) as bigint) as n_terms, cast(len(list_distinct(t)) as bigint) as n_distinct, md5(array_to_string(t, ' ')) as digest from terms",
    "q_exact": f"with {_CORPUS}, {_EXACT} select * from exact",
    "q_exact_count": f"""with {_CORPUS} select * from (select id, cast((length(lower(text)) - length(replace(lower(text), 'calibration', ''))) / 11
      + (length(lower(text)) - length(replace(lower(text), 'error', ''))) / 5 + (length(lower(text)) - length(replace(lower(text), 'or', ''))) / 2 as bigint) as score from corpus) where score > 0""",
    "q_bm25": f"with {_WITH_TERMS}, {_Q}, {_BM25} select * from bm25",
    "q_hash_embed": f"with {_WITH_TERMS}, {_EMBED} select id, count(*) as dims, round(sum(v * v), 6) as norm2 from embed group by id",
    "q_rrf": f"""with {_WITH_TERMS}, {_Q}, {_EXACT}, {_BM25},
      ranked as (select id, row_number() over (order by score desc, id) as r from exact union all select id, row_number() over (order by score desc, id) from bm25)
      select id, round(sum(1.0 / (60 + r)), 9) as score from ranked group by id""",
    "q_rerank": f"with {_WITH_TERMS}, {_Q}, {_LEX} select id, lex as score from lex where lex > 0 order by lex desc, id limit 30",
    "q_hybrid": f"""with {_WITH_TERMS}, {_Q}, {_EXACT}, {_BM25}, {_EMBED},
      qtf as (select term, count(*) as n from q group by term),
      qv as (select cast('0x' || md5(term)[1:8] as bigint) % 64 as dim, round(sum(case when cast('0x' || md5(term)[9:10] as bigint) % 2 = 0 then 1.0 else -1.0 end * (1 + ln(n))), 9) as v from qtf group by all),
      vec as (select id, round(sum(e.v * coalesce(qv.v, 0)) / (sqrt(sum(e.v * e.v)) * (select sqrt(sum(v * v)) from qv)), 9) as score
        from embed e left join qv using (dim) group by id having score > 0 order by score desc, id limit 30),
      ranked as (select id, row_number() over (order by score desc, id) as r from exact union all select id, row_number() over (order by score desc, id) from bm25
        union all select id, row_number() over (order by score desc, id) from vec),
      fused as (select id, round(sum(1.0 / (60 + r)), 9) as fused from ranked group by id), {_LEX},
      kept as (select id, fused, lex from fused join lex using (id) order by lex desc, fused desc, id limit 8)
      select id, round(fused + lex, 9) as score, row_number() over (order by round(fused + lex, 9) desc, fused desc, id) as rank from kept""",
    "q_vector_search": """with q as (select vec_id as query_id, cast(embedding as double[]) as q from embeddings where vec_id % 100 = 0),
      s as (select query_id, vec_id, round(list_cosine_similarity(cast(embedding as double[]), q), 6) as score from q cross join embeddings),
      r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score > 0) select * from r where rank <= 30""",
    "q_cosine": """with f as (select label, arg_min(embedding, vec_id) as q from embeddings group by label)
      select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(q as double[])), 6) as score from embeddings join f using (label)""",
    "q_sparse_cosine": f"""with {_WITH_TERMS}, tf as (select file_id, id, term, count(*) as n from (select c.file_id, id, unnest(t) as term from terms join corpus c using (id) where c.file_id is not null) group by all),
      first as (select file_id, min(id) as first from corpus where file_id is not null group by file_id),
      base as (select tf.file_id, term, n as m from tf join first on tf.file_id = first.file_id and id = first),
      other as (select file_id, sum(m * m) as m2 from base group by file_id)
      select id, round(sum(n * coalesce(m, 0)) / sqrt(cast(sum(n * n) as double) * any_value(m2)), 6) as score
      from tf left join base using (file_id, term) join other using (file_id) group by id""",
    "q_ir_metrics": """with h as (select distinct query_id, hit_id, file_id, score from search_hits where file_id is not null and score is not null and not isnan(score)),
      gold as (select query_id, min(file_id) as gold from h group by query_id),
      ranked as (select *, row_number() over (partition by query_id order by score desc, hit_id) as rank from h qualify rank <= 10),
      first as (select g.query_id, min(rank) as rank from gold g left join ranked r on g.query_id = r.query_id and gold = file_id group by g.query_id)
      select count(*) as queries, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 9) as pass_at_5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 9) as recall_at_10, round(avg(coalesce(1.0 / rank, 0.0)), 9) as mrr_at_10 from first""",
}
