"""Queries over event state and dataset governance, and the same in SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import context as C
from papyrine.operators import governance as G
from papyrine.operators import state as T
from papyrine.operators.windows import best, neighbours, numbered
from papyrine.sources.tables import table


def norm_split(c):
    w = F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when(w.isin("train", "training"), "train").when(w.isin("validation", "val", "dev", "valid"), "validation").when(w == "test", "test")


def log(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", "props")


def q_next_sequence(spark, d):
    return T.next_sequence(log(spark, d).select("user_id", F.col("event_id").alias("sequence")), "user_id", "sequence")


def q_version_audit(spark, d):
    """Each user's events of a type as appends to one entry; every seventh brings a version that is one too high."""
    rows = numbered(log(spark, d).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
    appends = rows.select("user_id", "event_type", "event_id", (F.col("n") - F.floor(F.col("n") / 7) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).cast("bigint").alias("version"))
    a = T.accepted_appends(appends, ["user_id", "event_type"], "event_id", "version")
    return a.groupBy("user_id", "event_type").agg(F.count("*").alias("appends"), F.count_if("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("version"))).alias("version"))


def _entries(spark, d):
    return log(spark, d).select("user_id", "event_type", "event_id", F.array((F.col("event_id") % 40).cast("string")).alias("sources"), (F.col("event_id") % 9 == 0).alias("invalidated"))


def q_active_entries(spark, d):
    return T.active_entries(_entries(spark, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def q_cascade(spark, d):
    """Active entries after source 7 and 8 are gone; a user's entries are one task."""
    gone = table(spark, d, "nation").where("n_nationkey in (7, 8)").select(F.col("n_nationkey").cast("string").alias("source"))
    active = T.active_entries(_entries(spark, d), ["user_id", "event_type"], "event_id").drop("invalidated")
    return T.invalidate_sources(active, "user_id", "sources", gone).select("user_id", "event_type", "invalidated")


def q_segments(spark, d):
    """Events as messages of a talk: the first twelve stand in two segments of eight and four, and a broken third holds the newest."""
    m = log(spark, d).select(F.col("user_id").alias("talk"), F.col("event_id").alias("id"))
    n = numbered(m, ["talk"], ["id"])
    total = m.groupBy("talk").agg(F.count("*").alias("all"))
    old = n.join(total, "talk").select("talk", F.when(F.col("n") <= 8, 0).when(F.col("n") <= 12, 1).when(F.col("n") == F.col("all"), 2).alias("segment"), "id").where("segment is not null")
    return T.segments(m, old, 12, 8)


def q_summary_fallback(spark, d):
    e = log(spark, d).select(F.col("user_id").alias("talk"), F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant").alias("role"), F.concat_ws("  ", "event_type", "props").alias("text"))
    s = T.fallback_summary(e, e.where("id % 5 = 0"))
    return s.select("talk", F.array_join("topics", "|").alias("topics"), F.array_join("decisions", "|").alias("decisions"))


def q_retries(spark, d):
    """Errors as failed jobs."""
    j = log(spark, d).where("event_type = 'error'").select("event_id", T.after_failure((F.col("event_id") % 9 + 1).cast("int"), (F.col("event_id") % 4 + 3).cast("int"), F.col("event_id") % 5 > 0).alias("j"))
    return j.select("event_id", "j.*")


def q_stale_jobs(spark, d):
    """Running jobs whose heartbeat is older than half a minute before the log's last entry."""
    jobs = log(spark, d).select("event_id", F.col("ts").alias("heartbeat_at"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("queued").alias("status"))
    last = jobs.agg(F.max("heartbeat_at").alias("now"))
    return T.stale(jobs.crossJoin(F.broadcast(last)), F.col("now"), 86_400).select("event_id")


def q_topo(spark, d):
    """Suppliers as steps, each needing the one with half its number and, if even, the one before."""
    s = table(spark, d, "lineitem").where("l_suppkey > 0").select(F.col("l_suppkey").alias("node")).distinct()
    half = F.floor(F.col("node") / 2)
    edges = s.select("node", half.alias("needs")).where("needs > 0").join(s.select(F.col("node").alias("needs")), "needs", "left_semi")
    return T.dependency_levels(s, edges).select("node", F.col("level").cast("int").alias("depth"))


def q_running_budget(spark, d):
    """Each user's usage against a budget of tokens, tool calls and helper calls: what overflows is refused."""
    e = log(spark, d).select("user_id", "event_id", F.round("value").cast("bigint").alias("tokens"), (F.col("event_id") % 3).alias("tools"), (F.col("event_id") % 2).alias("helpers"))
    return C.admitted(e, "user_id", "event_id", {"tokens": 2000, "tools": 25, "helpers": 12})


def q_cascade_delete(spark, d):
    """Conversations as owners of papers; those whose number ends in 7 are deleted."""
    links = table(spark, d, "training_samples").select(F.explode("conversation_ids").alias("owner"), "paper_ids").select("owner", F.explode("paper_ids").alias("item")).where("owner is not null and item is not null")
    return T.cascade_delete(links, links.where("owner like '%7'").select("owner"))


def q_unique_texts(spark, d):
    texts, _ = T.unique_texts(table(spark, d, "documents"), "doc_id", "text")
    return texts.select("text_id", "first", "copies")


def q_promotion(spark, d):
    """Adjudications as a log of candidates per annotator: promoted if a label was settled and both annotators agree, rolled back
    where it is pending."""
    p = table(spark, d, "annotation_pairs").where("case_id is not null and annotator_a_id is not null and annotated_at is not null").groupBy("annotator_a_id", "case_id").agg(F.min(F.struct("annotated_at", "adjudication", "annotator_a_label", "annotator_b_label")).alias("r"))
    rows = p.select(F.col("annotator_a_id").alias("dataset"), F.col("case_id").alias("candidate"), F.struct("r.annotated_at", "case_id").alias("at"), F.when(F.col("r.adjudication") == "pending", "rollback").otherwise("promote").alias("action"), F.col("r.adjudication").isNotNull().alias("approved"), (F.lower("r.annotator_a_label") == F.lower("r.annotator_b_label")).alias("agreed"))
    return T.latest_promotions(rows, ["approved", "agreed"])


def q_leakage(spark, d):
    """Values of eval cases that stand in several splits."""
    c = table(spark, d, "eval_cases").where("case_id is not null").select("case_id", norm_split(F.col("split")).alias("split"), "source_id", "source_cluster_id", "text_fingerprint", "paper_ids", "conversation_ids").distinct()
    return G.leakage(c, "case_id", "split", ["source_id", "source_cluster_id", "text_fingerprint"], ["paper_ids", "conversation_ids"])


def q_case_validators(spark, d):
    c = table(spark, d, "eval_cases").where("case_id is not null").drop("created_at", "ingested_at").distinct()
    return G.violations(c, "case_id", G.case_problems()).select("case_id", F.array_join("problems", ",").alias("problems"))


def q_row_validators(spark, d):
    s = table(spark, d, "training_samples").where("sample_id is not null").select("sample_id", "sft_target", "chosen", "rejected", "privacy", "consent_id", "anonymized").distinct()
    return G.violations(s, "sample_id", G.sample_problems()).select("sample_id", F.array_join("problems", ",").alias("problems"))


def q_traceable_rate(spark, d):
    t = G.traceable(table(spark, d, "eval_cases").select("case_id", "source_id", "source_cluster_id", "text_fingerprint", "authorization_status").distinct(), ["source_id", "source_cluster_id", "text_fingerprint", "authorization_status"])
    return t.withColumn("rate", F.round("rate", 9))


def q_consensus_gold(spark, d):
    p = table(spark, d, "annotation_pairs").where("case_id is not null and annotator_a_label is not null and annotator_b_label is not null and annotator_a_id is not null").groupBy("case_id").agg(F.min(F.struct(F.lower(F.trim("annotator_a_label")).alias("a"), F.lower(F.trim("annotator_b_label")).alias("b"), F.col("annotator_a_id").alias("w"))).alias("r"))
    both = F.array(*[F.struct(F.lit(i).alias("place"), F.col("r")[k].alias("kind"), F.col("r.w").alias("answer")) for i, k in ((1, "a"), (2, "b"))])
    return G.consensus_gold(p.select(F.col("case_id").alias("item"), F.inline(both)))


def q_manifest(spark, d):
    """A hash of each file's chunks."""
    c = table(spark, d, "chunks").where("file_id is not null").select("file_id", "chunk_id", "text", "page_start").distinct()
    return G.manifest(c, "file_id", "chunk_id", ["text", "page_start"])


def q_cluster_id(spark, d):
    """Requests' fingerprints and the clusters they stand for, which hold exact copies alone."""
    c = table(spark, d, "eval_cases").where("case_id is not null and prompt is not null").select("case_id", "prompt").distinct()
    finger = F.sha2(F.lower(F.trim(F.regexp_replace("prompt", r"\s+", " "))), 256)
    return c.select("case_id", F.concat(F.lit("embedding-v1-"), finger).alias("cluster_id"))


def q_chunk_links(spark, d):
    c = table(spark, d, "chunks").where("file_id is not null").select("file_id", F.coalesce(F.array_join("section_path", "/"), F.lit("")).alias("section"), "chunk_id").distinct()
    return neighbours(c, ["file_id", "section"], ["chunk_id"], "chunk_id").select("chunk_id", "previous", "next")


def q_round_robin(spark, d):
    o = numbered(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"])
    return o.select("o_orderkey", ((F.col("n") - 1) % 4).alias("worker"))


def q_batches(spark, d):
    """Customers of a segment in batches of seven."""
    c = numbered(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"])
    return c.select("c_custkey", F.floor((F.col("n") - 1) / 7).alias("batch"))


def q_nearest_rank(spark, d):
    """Percentiles by nearest rank, each a value that was measured: values and their counts are numbered, not rows."""
    s = table(spark, d, "case_scores").distinct().where("latency_ms > 0 and system_id is not null").groupBy("system_id", "latency_ms").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(T.Window.partitionBy("system_id").orderBy("latency_ms"))
    n = F.sum("c").over(T.Window.partitionBy("system_id"))
    r = s.withColumns({"upto": upto, "n": n})
    return r.groupBy("system_id").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("latency_ms"))).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)])


def q_public_columns(spark, d):
    """Live customers between two keys, in some segments, on the second page, with public columns alone."""
    c = table(spark, d, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal")))
    return T.live(c).where(F.col("c_custkey").between(50, 900) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").offset(10).limit(40)


def q_workspace_search(spark, d):
    """Files of the workspace by what their paths, papers and texts share with a query; entries that are gone don't come up."""
    r = table(spark, d, "render_samples").where("file_id is not null").groupBy("file_id").agg(F.min("path").alias("path"), F.min("paper_id").alias("paper_id"), F.max("page_count").alias("n"))
    c = table(spark, d, "chunks").where("file_id is not null and text is not null").groupBy("file_id").agg(F.min(F.struct("chunk_id", "text")).alias("t"))
    q = ["calibration", "error", "pdf", "files"]
    terms = F.regexp_extract_all(F.lower(F.concat_ws(" ", "path", "paper_id", "t.text")), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), F.lit(1))
    e = r.where("n % 11 > 0").join(c, "file_id").select(F.col("file_id").alias("id"), "path", terms.alias("terms"))
    best_ = C.remembered_entries(e, F.col("terms"), F.lit(0.0), F.lit(False), q, 20)
    return best_.join(e.select("id", "path"), "id")


QUERIES = {f.__name__: f for f in (q_next_sequence, q_version_audit, q_active_entries, q_cascade, q_segments, q_summary_fallback, q_retries, q_stale_jobs, q_topo, q_running_budget, q_cascade_delete, q_unique_texts, q_promotion, q_leakage, q_case_validators, q_row_validators, q_traceable_rate, q_consensus_gold, q_manifest, q_cluster_id, q_chunk_links, q_round_robin, q_batches, q_nearest_rank, q_public_columns, q_workspace_search)}

_ENT = "en as (select user_id, event_type, event_id, event_id % 40 as src, event_id % 9 = 0 as inv from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1), act as (select * from en where not inv)"
_NS = lambda c: f"case regexp_replace(lower({c}), '[^a-z]', '', 'g') when 'train' then 'train' when 'training' then 'train' when 'validation' then 'validation' when 'val' then 'validation' when 'dev' then 'validation' when 'valid' then 'validation' when 'test' then 'test' end"

SQL = {
    "q_next_sequence": "select user_id, max(event_id) + 1 as next from events group by user_id",
    "q_version_audit": """with recursive a as (select user_id, event_type, event_id, n, n - n // 7 + case when event_id % 7 = 0 then 1 else 0 end as v from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) x),
      w as (select user_id, event_type, n, case when v = 1 then 1 else 0 end as cur, v = 1 as ok from a where n = 1 union all select a.user_id, a.event_type, a.n, case when a.v = w.cur + 1 then a.v else w.cur end, a.v = w.cur + 1 from w join a on a.user_id = w.user_id and a.event_type = w.event_type and a.n = w.n + 1)
      select user_id, event_type, count(*) as appends, count(*) filter (ok) as accepted, cast(nullif(max(cur), 0) as bigint) as version from w group by 1, 2""",
    "q_active_entries": f"with {_ENT} select user_id, event_type, event_id from act",
    "q_cascade": f"with {_ENT} select user_id, event_type, bool_or(src in (7, 8)) over (partition by user_id) as invalidated from act",
    "q_segments": """with m as (select user_id as talk, event_id as id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as al from events), o as (select * from m where n <= al - 12), s as (select talk, al - 12 >= 8 as a, al - 12 >= 12 as b from (select distinct talk, al from m) x)
      select o.talk, id, cast(case when a and b then case when n <= 8 then 0 when n <= 16 then 1 else 2 + (n - 17) // 8 end when a then case when n <= 8 then 0 else 1 + (n - 9) // 8 end else (n - 1) // 8 end as bigint) as segment from o join s using (talk)""",
    "q_summary_fallback": """with m as (select user_id as talk, event_id as id, event_type in ('click', 'view') as u, event_type || ' ' || props as line from events where event_id % 5 > 0), l as (select * from m qualify row_number() over (partition by talk, u order by id desc) <= 3), d as (select talk, u, line, min(id) as id from l group by 1, 2, 3)
      select talk, coalesce(string_agg(line, '|' order by id) filter (u), '') as topics, coalesce(string_agg(line, '|' order by id) filter (not u), '') as decisions from d group by talk""",
    "q_retries": "with j as (select event_id, event_id % 9 + 1 as a, event_id % 5 > 0 and event_id % 9 + 1 <= event_id % 4 + 3 as again from events where event_type = 'error') select event_id, case when again then 'queued' else 'failed' end as status, case when again then least(60.0, pow(2, a - 1))::double end as delay, not again as dead from j",
    "q_stale_jobs": "select event_id from events where event_id % 3 = 0 and ts < (select max(ts) from events) - interval '1' day",
    "q_topo": "with recursive s as (select distinct l_suppkey as n from lineitem where l_suppkey > 0), e as (select a.n, b.n as p from s a join s b on b.n = a.n // 2), w as (select n, 0 as l from s where n not in (select n from e) union all select e.n, l + 1 from w join e on e.p = w.n) select n as node, cast(max(l) as int) as depth from w group by n",
    "q_running_budget": """with recursive i as (select user_id, event_id, cast(round(value) as bigint) as t, event_id % 3 as c, event_id % 2 as h, row_number() over (partition by user_id order by event_id) as k from events),
      w(user_id, k, t, c, h, event_id, ok) as (select distinct user_id, 0, 0::bigint, 0::bigint, 0::bigint, 0::bigint, false from i union all select i.user_id, i.k, case when w.t + i.t <= 2000 and w.c + i.c <= 25 and w.h + i.h <= 12 then w.t + i.t else w.t end, case when w.t + i.t <= 2000 and w.c + i.c <= 25 and w.h + i.h <= 12 then w.c + i.c else w.c end,
        case when w.t + i.t <= 2000 and w.c + i.c <= 25 and w.h + i.h <= 12 then w.h + i.h else w.h end, i.event_id, w.t + i.t <= 2000 and w.c + i.c <= 25 and w.h + i.h <= 12 from w join i on i.user_id = w.user_id and i.k = w.k + 1) select user_id, event_id from w where ok""",
    "q_cascade_delete": "with l as (select distinct o, p from (select o, unnest(paper_ids) as p from (select unnest(conversation_ids) as o, paper_ids from training_samples) x) y where o is not null and p is not null) select p as item, count(*) filter (right(o, 1) <> '7') as refs, case when count(*) filter (right(o, 1) <> '7') = 0 then 'delete' else 'update' end as action from l group by p having count(*) filter (right(o, 1) = '7') > 0",
    "q_unique_texts": "select sha256(trim(text, ' ')) as text_id, min(doc_id) as first, count(*) as copies from documents where text is not null group by 1",
    "q_promotion": """with recursive p as (select annotator_a_id as ds, case_id, min({'t': annotated_at, 'a': adjudication, 'x': annotator_a_label, 'y': annotator_b_label}) as r from annotation_pairs where case_id is not null and annotator_a_id is not null and annotated_at is not null group by 1, 2),
      a as (select ds, case_id, r.a = 'pending' as back, row_number() over (partition by ds order by r.t, case_id) as k from p where r.a = 'pending' or (r.a is not null and lower(r.x) = lower(r.y))), w(ds, k, st) as (select distinct ds, 0, []::varchar[] from a union all select w.ds, a.k, case when back then st[1:greatest(len(st) - 1, 0)] else list_append(st, case_id) end from w join a on a.ds = w.ds and a.k = w.k + 1)
      select ds as dataset, len(arg_max(st, k)) as version, arg_max(st, k)[-1] as candidate from w group by ds""",
    "q_leakage": f"""with c as (select distinct case_id, {_NS("split")} as s, source_id, source_cluster_id, text_fingerprint, paper_ids, conversation_ids from eval_cases where case_id is not null), k as (select 'source_id' as kind, source_id as v, s, case_id from c union all select 'source_cluster_id', source_cluster_id, s, case_id from c union all select 'text_fingerprint', text_fingerprint, s, case_id from c
      union all select 'paper_ids', unnest(list_distinct(paper_ids)), s, case_id from c union all select 'conversation_ids', unnest(list_distinct(conversation_ids)), s, case_id from c) select kind, v as value, count(distinct s) as splits, count(*) as records from k where v is not null and s is not null group by 1, 2 having count(distinct s) > 1""",
    "q_case_validators": """with c as (select distinct * exclude (created_at, ingested_at) from eval_cases where case_id is not null), n as (select *, len(list_filter(coalesce(paper_ids, []), lambda p: p is not null)) as n from c), v as (select case_id, concat_ws(',', case when coalesce(authorization_status, 'unauthorized') = 'unauthorized' then 'unauthorized' end, case when difficulty in ('L2', 'L3', 'L4', 'L5') and n = 0 then 'paper_missing' end,
      case when difficulty in ('L4', 'L5') and n < 2 then 'papers_too_few' end, case when lower(trim(split, ' ')) = 'test' and usable_for_training then 'test_for_training' end, case when coalesce(trim(prompt, ' '), '') = '' then 'prompt_missing' end, case when coalesce(trim(source_id, ' '), '') = '' then 'source_missing' end) as problems from n) select * from v where problems <> ''""",
    "q_row_validators": """with s as (select distinct sample_id, sft_target is not null as t, chosen is not null as c, rejected is not null as r, coalesce(privacy, '') = 'private_authorized' as p, consent_id, anonymized, sft_target, chosen, rejected, privacy from training_samples where sample_id is not null),
      v as (select sample_id, concat_ws(',', case when t = (c and r) then 'targets' end, case when c <> r then 'half_a_pair' end, case when p and coalesce(consent_id, '') = '' then 'consent_missing' end, case when p and not coalesce(anonymized, false) then 'not_anonymised' end, case when not p and consent_id is not null then 'consent_not_asked_for' end) as problems from s) select * from v where problems <> ''""",
    "q_traceable_rate": "with c as (select distinct case_id, source_id, source_cluster_id, text_fingerprint, authorization_status from eval_cases), f as (select trim(coalesce(source_id, ''), ' ') <> '' and trim(coalesce(source_cluster_id, ''), ' ') <> '' and trim(coalesce(text_fingerprint, ''), ' ') <> '' and trim(coalesce(authorization_status, ''), ' ') <> '' as ok from c) select count(*) as \"rows\", count(*) filter (ok) as traceable, round(coalesce(count(*) filter (ok) / count(*), 1.0), 9) as rate from f",
    "q_consensus_gold": "with p as (select case_id, min({'a': lower(trim(annotator_a_label, ' ')), 'b': lower(trim(annotator_b_label, ' ')), 'w': annotator_a_id}) as r from annotation_pairs where case_id is not null and annotator_a_label is not null and annotator_b_label is not null and annotator_a_id is not null group by case_id) select case_id as item, r.a as kind, r.w as answer from p where r.a = r.b and r.a <> 'unanswerable' and coalesce(trim(r.w, ' '), '') <> ''",
    "q_manifest": """with c as (select distinct file_id, chunk_id, text, page_start from chunks where file_id is not null), h as (select file_id, sha256(concat_ws(chr(31), chunk_id, coalesce(text, chr(0)), coalesce(page_start::varchar, chr(0)))) as h from c)
      select file_id, count(*) as "rows", sha256(concat_ws(':', count(*)::varchar, sum(cast('0x' || h[1:12] as bigint))::varchar, sum(cast('0x' || h[13:24] as bigint))::varchar, sum(cast('0x' || h[25:36] as bigint))::varchar, sum(cast('0x' || h[37:48] as bigint))::varchar, sum(cast('0x' || h[49:60] as bigint))::varchar)) as sha256 from h group by file_id""",
    "q_cluster_id": "select distinct case_id, 'embedding-v1-' || sha256(lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g'), ' '))) as cluster_id from eval_cases where case_id is not null and prompt is not null",
    "q_chunk_links": "select chunk_id, lag(chunk_id) over w as previous, lead(chunk_id) over w as next from (select distinct file_id, coalesce(array_to_string(section_path, '/'), '') as s, chunk_id from chunks where file_id is not null) x window w as (partition by file_id, s order by chunk_id)",
    "q_round_robin": "select o_orderkey, (row_number() over (partition by o_orderpriority order by o_orderkey) - 1) % 4 as worker from orders",
    "q_batches": "select c_custkey, (row_number() over (partition by c_mktsegment order by c_custkey) - 1) // 7 as batch from customer",
    "q_nearest_rank": "with s as (select distinct * from case_scores), v as (select system_id, list_sort(list(latency_ms)) as v from s where latency_ms > 0 and system_id is not null group by system_id) select system_id, v[cast(ceil(len(v) * 0.5) as int)] as p50, v[cast(ceil(len(v) * 0.95) as int)] as p95 from v",
    "q_public_columns": "select c_custkey, c_name, c_mktsegment from customer where c_custkey % 10 > 0 and c_custkey between 50 and 900 and c_mktsegment in ('BUILDING', 'MACHINERY') order by c_custkey limit 40 offset 10",
    "q_workspace_search": """with r as (select file_id, min(path) as path, min(paper_id) as paper_id, max(page_count) as n from render_samples where file_id is not null group by file_id), c as (select file_id, arg_min(text, chunk_id) as text from chunks where file_id is not null and text is not null group by file_id),
      e as (select r.file_id as id, path, list_distinct(regexp_extract_all(lower(concat_ws(' ', path, paper_id, text)), '[\\p{L}\\p{N}\\p{M}_]+')) as t from r join c using (file_id) where n % 11 > 0) select id, round(2 * len(list_intersect(t, ['calibration', 'error', 'pdf', 'files'])) / 4.0, 6)::double as score, path from e order by score desc, id limit 20""",
}
