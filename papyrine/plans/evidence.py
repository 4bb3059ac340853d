"""Queries over ranked evidence and contexts to contract, and the same in SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import rules as X
from papyrine.functions.text import cosine, retrieval_terms
from papyrine.operators import context as C
from papyrine.operators import retrieval as R
from papyrine.operators import sections as S
from papyrine.plans import retrieval as P
from papyrine.plans.sections import catalog
from papyrine.sources.tables import table

QUERY = P.QUERY


def ranked_hits(spark, d, n=8):
    """The n best chunks with a file by BM25, with rank."""
    c = P.scan(spark, d).where("file_id is not null")
    rows = R.bm25_signals(R.signals(c, QUERY), QUERY).select("id", F.col("bm25").alias("score")).where("score > 0")
    return R.top(rows, "score", "id", n).select("id", "score", F.row_number().over(R.Window.orderBy(F.col("score").desc(), "id")).cast("bigint").alias("rank"))


def placed(spark, d):
    return P.scan(spark, d).where("file_id is not null").select("id", "file_id", "section_path", "page_start").distinct()


def q_expand_section(spark, d):
    return R.expand_section(ranked_hits(spark, d), placed(spark, d).where("section_path is not null"))


def q_adjacent(spark, d):
    return R.with_neighbours(ranked_hits(spark, d), placed(spark, d))


def q_balanced_topk(spark, d):
    """Files of degraded scans, by their own statistics; and files that have nothing."""
    scope = table(spark, d, "render_samples").where("lower(profile) like '%degraded%'").select("file_id").distinct()
    return R.balanced(P.scan(spark, d), QUERY, scope)


def q_summary_budget(spark, d):
    c = P.scan(spark, d).where("file_id is not null").select("file_id", F.coalesce(F.array_join("section_path", "/"), F.lit("")).alias("section"), "id", F.length("text").cast("bigint").alias("size")).distinct()
    return R.coverage(c, 12_000).select("file_id", F.col("id").alias("chunk_id"), "score")


def q_section_scope(spark, d):
    """Chunks in the scope of three hints: a word, a word in the other language, and one that nothing has."""
    rows = None
    for hint in ("training strategy", "方法", "nowhere"):
        one = R.scoped_sections(P.scan(spark, d).select("id", "section_path").distinct(), hint).groupBy(F.lit(hint).alias("hint")).agg(F.count("*").alias("chunks"), F.min("id").alias("first"), F.max("id").alias("last"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def q_page_hybrid(spark, d):
    c = P.scan(spark, d).where("file_id is not null and page_start is not null").select("file_id", "page_start", "id", "text").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n")
    pages = c.groupBy("file_id", "page_start").agg(text.alias("text")).select(F.concat_ws(":", "file_id", F.lpad(F.col("page_start").cast("string"), 6, "0")).alias("id"), "text")
    return R.pages(pages, QUERY).select("id", "score", F.col("rank").cast("bigint").alias("rank"))


def q_section_search(spark, d):
    """A section of the first file asked for in two ways: its chunks under a budget, and the best of them with their neighbours."""
    c = P.scan(spark, d).where("file_id is not null")
    known = catalog(spark, d)
    file = known.agg(F.min("file_id").alias("file_id"))
    refs = S.parse(file.select(F.lit("r").alias("ref_id"), "file_id", F.lit("Summarize section 2").alias("q")), "q").withColumns({"current_id": F.lit(None).cast("string"), "previous_id": F.lit(None).cast("string")})
    chosen = S.resolve(refs, known.join(file, "file_id", "left_semi"), None).where("status = 'resolved'").select("section_id")
    whole = F.concat("file_id", F.lit("/"), F.array_join("section_path", "/"))
    below = (F.col("s") == F.col("section_id")) | F.startswith(F.col("s"), F.concat("section_id", F.lit("/")))
    scope = c.withColumn("s", whole).join(F.broadcast(chosen), below).select("id", "file_id", "text", "s").distinct()
    summary = R.coverage(scope.select("file_id", F.col("s").alias("section"), "id", F.length("text").cast("bigint").alias("size")), 4000).select(F.lit("summary").alias("mode"), "id", "score")
    hits = R.ranked(R.bm25_signals(R.signals(scope, QUERY), QUERY), QUERY)
    qa = R.with_neighbours(hits, scope).select(F.lit("qa").alias("mode"), "id", "score")
    return summary.unionByName(qa).withColumn("score", F.round("score", 6))


def q_cited_sentences(spark, d):
    texts = P.scan(spark, d).select("id", "text").distinct()
    return C.cited_sentences(ranked_hits(spark, d).select("id", "score"), texts, F.lit("How is the calibration error reported?")).withColumn("coverage", F.round("coverage", 9))


def q_memory_rank(spark, d):
    """Documents as remembered entries, each with the vector of its number's last digits, a third of another vector space."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 500).alias("v"), "embedding").where("v = vec_id")
    first = e.where("v = 0").select(F.col("embedding").alias("q"))
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 500).alias("v")).join(e, "v").crossJoin(F.broadcast(first))
    return C.remembered_entries(t, X.memory_terms(F.col("text")), cosine(F.col("embedding"), F.col("q")), F.col("id") % 3 > 0, ["calibration", "error", "results", "the"], 20)


def _messages(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.concat_ws(" ", "event_type", "props").alias("text"))


ASKED = ["click", "view", "5", "k", "69"]


def q_related_context(spark, d):
    m = _messages(spark, d)
    return C.related_messages(m, "user_id", "event_id", F.col("text"), retrieval_terms(F.col("text")), ASKED, True, characters=70, overlap=0.3)


def q_memory_select(spark, d):
    m = _messages(spark, d)
    return C.remembered_messages(m, "user_id", "event_id", retrieval_terms(F.col("text")), ASKED)


def q_context_pack(spark, d):
    """Returned items of an order first, then others that fit into a quantity of 100."""
    i = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("o"), F.col("l_quantity").cast("bigint").alias("tokens"), (F.col("l_returnflag") == "R").alias("required"))
    taken = C.admitted(i, "l_orderkey", "o", {"tokens": 100}, "required")
    return taken.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum(F.col("o.l_quantity").cast("bigint")).alias("tokens"))


def q_budget_admit(spark, d):
    """Each user's first 40 events under a budget of calls and one of tokens."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3 + 1).alias("calls"), F.round("value").cast("bigint").alias("tokens"))
    return C.admitted(e, "user_id", "event_id", {"calls": 30, "tokens": 700}, slots=40)


QUERIES = {f.__name__: f for f in (q_expand_section, q_adjacent, q_balanced_topk, q_summary_budget, q_section_scope, q_page_hybrid, q_section_search, q_cited_sentences, q_memory_rank, q_related_context, q_memory_select, q_context_pack, q_budget_admit)}

_WITH = lambda corpus: f"corpus as ({corpus}), terms as (select id, text, {P._TERMS.format('text')} as t from corpus)"
_IN_FILES = "select distinct chunk_id as id, file_id, text, section_path, page_start from chunks where text is not null and file_id is not null"
_HITS = f"{_WITH(_IN_FILES)}, {P._Q}, {P._BM25}, hits as (select id, score, row_number() over (order by score desc, id) as rank from bm25 qualify rank <= 8)"
_PLACED = "placed as (select *, row_number() over (partition by file_id order by id) as pos from (select distinct id, file_id from corpus) x)"
_QTF = "qtf as (select term, count(*) as n from q group by term)"
_SPARSE = f"tfs as (select id, term, count(*) as n from (select id, unnest(t) as term from terms) group by all), {_QTF}, sp as (select id, round(coalesce(sum(tfs.n * qtf.n), 0) / (sqrt(sum(tfs.n * tfs.n)) * (select sqrt(sum(n * n)) from qtf)), 9) as score from tfs left join qtf using (term) group by id having score > 0 order by score desc, id limit 30)"
_DENSE = P._EMBED + f""", {_QTF}, qv as (select cast('0x' || md5(term)[1:8] as bigint) % 64 as dim, round(sum(case when cast('0x' || md5(term)[9:10] as bigint) % 2 = 0 then 1.0 else -1.0 end * (1 + ln(n))), 9) as v from qtf group by all),
  sp as (select id, round(sum(e.v * coalesce(qv.v, 0)) / (sqrt(sum(e.v * e.v)) * (select sqrt(sum(v * v)) from qv)), 9) as score from embed e left join qv using (dim) group by id having score > 0 order by score desc, id limit 30)"""
_FUSE = f"""ranked as (select id, row_number() over (order by score desc, id) as r from exact union all select id, row_number() over (order by score desc, id) from bm25 union all select id, row_number() over (order by score desc, id) from sp),
  fused as (select id, round(sum(1.0 / (60 + r)), 9) as fused from ranked group by id), {P._LEX}, kept as (select id, fused, lex from fused join lex using (id) order by lex desc, fused desc, id limit 8), final as (select id, round(fused + lex, 9) as score, row_number() over (order by round(fused + lex, 9) desc, fused desc, id) as rank from kept)"""
_NEAR = """near as (select file_id, unnest([pos - 1, pos, pos + 1]) as pos, rank from {h} join placed using (id)), nr as (select p.file_id, p.pos, p.id, min(rank) as rank from near join placed p on p.file_id = near.file_id and p.pos = near.pos group by 1, 2, 3),
  cu as (select rank, sum(count(*)) over (order by rank) as n from nr group by rank), lst as (select coalesce(min(rank) filter (n >= 8), max(rank)) as l from cu), nb as (select id, file_id, pos, row_number() over (order by file_id, pos) as rank from nr, lst where nr.rank <= l),
  adj as (select nb.id, coalesce(h.score, greatest(0, (select arg_min(score, rank) from {h}) - 0.01)) as score, nb.rank from nb left join {h} h on h.id = nb.id where nb.rank <= 8)"""


def _cover(source: str, budget: int) -> str:
    return f"""ch as ({source}), n0 as (select *, row_number() over (partition by file_id order by id) as n, count(*) over (partition by file_id) as al, sum(size) over (partition by file_id) as tot, row_number() over (partition by file_id, section order by id) as sn from ch),
  m0 as (select *, n = 1 or n = al or n = al // 2 + 1 or sn = 1 as must from n0), bg as (select *, row_number() over (partition by file_id order by n) as k from m0 where tot > {budget} and not must), st as (select file_id, cast(sum(size) as bigint) as used from m0 where tot > {budget} and must group by file_id),
  wk(file_id, k, used, id, n, taken) as (select st.file_id, 0, used, '', 0, false from st union all select w.file_id, bg.k, case when w.used + bg.size <= {budget} then w.used + bg.size else w.used end, bg.id, bg.n, w.used + bg.size <= {budget} from wk w join bg on bg.file_id = w.file_id and bg.k = w.k + 1),
  al0 as (select file_id, id, n from m0 where tot <= {budget} or must union all select file_id, id, n from wk where taken), cov as (select file_id, id, round(greatest(0, 1 - 0.001 * (row_number() over (partition by file_id order by n) - 1)), 6)::double as score from al0)"""


_MSG = f"m as (select user_id, event_id, event_type || ' ' || props as text from events), t as (select user_id, event_id, length(text) as size, len(list_intersect(list_distinct({P._TERMS.format('text')}), ['click', 'view', '5', 'k', '69'])) as s from m)"

SQL = {
    "q_expand_section": f"""with {_HITS}, pl as (select distinct id, file_id, section_path, page_start from corpus where section_path is not null), home as (select file_id, section_path, greatest(0, score - 0.01) as near from hits join pl using (id) where rank = 1), ins as (select pl.id, page_start, near from pl join home h on pl.file_id = h.file_id and pl.section_path = h.section_path order by page_start nulls first, pl.id limit 8),
      u as (select ins.id, coalesce(score, near) as score, 0 as late, coalesce(page_start, -1) as at_ from ins left join hits using (id) union all select id, score, 1, rank from hits where id not in (select id from ins)) select id, score, row_number() over (order by late, at_, id) as rank from u qualify rank <= 8""",
    "q_adjacent": f"with {_HITS}, {_PLACED}, {_NEAR.format(h='hits')} select * from adj",
    "q_balanced_topk": f"""with sc as (select distinct file_id from render_samples where contains(lower(profile), 'degraded')), {_WITH("select distinct chunk_id as id, file_id, text from chunks where text is not null and file_id in (select file_id from sc)")}, {P._Q}, tt as (select c.file_id, terms.id, t from terms join (select distinct id, file_id from corpus) c using (id)), st as (select file_id, count(*) as docs, greatest(avg(len(t)), 1) as avgdl from tt group by file_id),
      po as (select file_id, id, greatest(dl, 1) as dl, term, count(*) as tf from (select file_id, id, len(t) as dl, unnest(t) as term from tt) where term in (select term from q) group by all), dfs as (select file_id, term, count(*) as df from po group by 1, 2), qw as (select term, count(*) as w from q group by term),
      b as (select po.file_id, po.id, round(sum(w * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from po join dfs on dfs.file_id = po.file_id and dfs.term = po.term join qw on qw.term = po.term join st on st.file_id = po.file_id group by 1, 2 having score > 0),
      r as (select *, row_number() over (partition by file_id order by score desc, id) as rank from b qualify rank <= greatest(1, 8 // (select count(*) from sc))), f as (select file_id, id, score, rank from r order by file_id, rank limit 8) select * from f union all select file_id, null, null, null from sc where file_id is not null and file_id not in (select file_id from r)""",
    "q_summary_budget": f"with recursive {_cover('select distinct file_id, coalesce(array_to_string(section_path, chr(47)), chr(0)) as section, chunk_id as id, length(text) as size from chunks where text is not null and file_id is not null'.replace('chr(0)', chr(39) * 2), 12000)} select file_id, id as chunk_id, score from cov",
    "q_section_scope": f"""with c as (select distinct chunk_id as id, section_path from chunks where text is not null), p as (select id, list_distinct({P._TERMS.format("array_to_string(coalesce(section_path, []), ' ')")}) as t from c), hs as (select * from (values ('training strategy', ['training', 'strategy']), ('方法', ['方', '法', '方法', 'methods', 'methodology', 'method']), ('nowhere', ['nowhere'])) v(hint, w)),
      m as (select hint, id, len(list_intersect(t, w)) > 0 as hit from p cross join hs), s as (select *, bool_or(hit) over (partition by hint) as some_ from m) select hint, count(*) as chunks, min(id) as first, max(id) as last from s where hit or not some_ group by hint""",
    "q_page_hybrid": f"""with c as (select distinct file_id, page_start, chunk_id, text from chunks where text is not null and file_id is not null and page_start is not null), {_WITH("select file_id || ':' || lpad(page_start::varchar, 6, '0') as id, string_agg(text, chr(10) order by chunk_id, text) as text from c group by file_id, page_start")}, {P._Q}, {P._EXACT}, {P._BM25}, {_SPARSE}, {_FUSE} select id, score, rank from final""",
    "q_section_search": f"""with recursive ff as (select min(file_id) as f from chunks where file_id is not null and len(section_path) > 0), ks as (select distinct section_path as sp from chunks, ff where file_id = f and len(section_path) > 0 and regexp_extract(section_path[len(section_path)], '^(\\d+(?:\\.\\d+)*)\\s', 1) = '2'), k1 as (select array_to_string(any_value(sp), '/') as sp from ks having count(*) = 1),
      {_WITH("select distinct chunk_id as id, file_id, text, array_to_string(section_path, '/') as s from chunks, ff, k1 where text is not null and file_id = f and (array_to_string(section_path, '/') = sp or starts_with(array_to_string(section_path, '/'), sp || '/'))")}, {_cover("select file_id, s as section, id, length(text) as size from corpus", 4000)}, {P._Q}, {P._EXACT}, {P._BM25}, {_DENSE}, {_FUSE}, {_PLACED}, {_NEAR.format(h='final')}
      select 'summary' as mode, id, score from cov union all select 'qa', id, round(score, 6) from adj""",
    "q_cited_sentences": f"""with {_HITS}, tx as (select distinct chunk_id as id, text from chunks where text is not null), s0 as (select id, score, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1<<|>>', 'g'), '(?:<<\\|>>|\\n)+'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) as ss from hits join tx using (id)),
      s1 as (select id, score, unnest(ss) as s, unnest(range(len(ss))) as place from s0), s2 as (select id, score, place, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9%]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')), ['calibration', 'error', 'reported']))::double / 3 as cov from s1)
      select 'C' || row_number() over (order by cov desc, score desc, id, place) as citation, id, place, round(cov, 9) as coverage from s2 where cov >= 0.5 order by cov desc, score desc, id, place limit 3""",
    "q_memory_rank": """with e as (select vec_id as v, cast(embedding as double[]) as e from embeddings where vec_id % 500 = vec_id), q as (select e as qe from e where v = 0), t as (select doc_id as id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')), ['calibration', 'error', 'results', 'the'])) / 4.0 as s, e from documents join e on v = doc_id % 500 where text is not null)
      select id, round(2 * s + case when id % 3 > 0 then list_cosine_similarity(e, qe) else 0.0 end, 6) as score from t, q order by score desc, id limit 20""",
    "q_related_context": f"""with {_MSG}, b as (select *, row_number() over (partition by user_id order by event_id desc) as back from t qualify back <= 12), p as (select * from b where s / 5.0 >= 0.3 or back <= 4), u as (select *, sum(size) over (partition by user_id order by back rows unbounded preceding) as used, row_number() over (partition by user_id order by back) as f from p) select user_id, event_id from u where used <= 70 or f = 1""",
    "q_memory_select": f"with {_MSG}, r as (select *, row_number() over (partition by user_id order by s desc, event_id) <= 6 and s > 0 as hit from t), a as (select *, coalesce(lag(hit) over (partition by user_id order by event_id), false) as af from r), n as (select *, row_number() over (partition by user_id order by event_id) as n from a where hit or af) select user_id, event_id from n where n <= 6",
    "q_context_pack": """with recursive i as (select l_orderkey as o, cast(l_quantity as bigint) as n, l_returnflag = 'R' as req, row_number() over (partition by l_orderkey, l_returnflag = 'R' order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k from lineitem),
      s as (select o, coalesce(sum(n) filter (req), 0)::bigint as used, count(*) filter (req) as c from i group by o), w(o, k, used, c) as (select o, 0, used, c from s union all select w.o, i.k, case when w.used + n <= 100 then w.used + n else w.used end, case when w.used + n <= 100 then c + 1 else c end from w join i on i.o = w.o and not req and i.k = w.k + 1)
      select o as l_orderkey, arg_max(c, k) as kept, arg_max(used, k) as tokens from w group by o having arg_max(c, k) > 0""",
    "q_budget_admit": """with recursive i as (select user_id, event_id, event_id % 3 + 1 as c, cast(round(value) as bigint) as t, row_number() over (partition by user_id order by event_id) as k from events qualify k <= 40),
      w(user_id, k, c, t, event_id, ok) as (select distinct user_id, 0, 0::bigint, 0::bigint, 0::bigint, false from i union all select i.user_id, i.k, case when w.c + i.c <= 30 and w.t + i.t <= 700 then w.c + i.c else w.c end, case when w.c + i.c <= 30 and w.t + i.t <= 700 then w.t + i.t else w.t end, i.event_id, w.c + i.c <= 30 and w.t + i.t <= 700 from w join i on i.user_id = w.user_id and i.k = w.k + 1)
      select user_id, event_id from w where ok""",
}
