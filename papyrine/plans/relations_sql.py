"""SQL that the queries of relations.py are held against; only DuckDB runs it."""

from __future__ import annotations

SQL: dict[str, str] = {
    "q_asof_prev": r"""select user_id, event_id, max(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as previous_purchase from events""",
    "q_chain_complete": r"""select user_id, count(distinct case when event_type in ('signup', 'view', 'purchase') then event_type end) = 3 as complete from events group by user_id""",
    "q_claim_links": r"""with h as (select distinct hit_id, query_id, chunk_id, file_id from search_hits), c as (select distinct chunk_id, file_id, page_start from chunks) select h.hit_id, case when h.chunk_id is null then 'missing' when c.chunk_id is null then 'unknown' when h.file_id is null or h.file_id <> c.file_id then 'unlinked' when c.page_start is null or c.page_start < 1 then 'invalid' else 'ok' end as issue from h left join c on h.chunk_id = c.chunk_id""",
    "q_comparison_all": r"""with c as (select distinct case_id, system_id, claim_support_rate from case_scores), cases as (select distinct case_id from c), dims as (select distinct system_id from c where system_id is not null), s as (select case_id, system_id, count(claim_support_rate) as n from c group by case_id, system_id) select k.case_id, d.system_id, coalesce(s.n, 0) as n, coalesce(s.n, 0) = 0 as missing from cases k cross join dims d left join s on s.case_id is not distinct from k.case_id and s.system_id = d.system_id""",
    "q_conflict_pr": r"""with votes as (select distinct case_id, lower(trim(annotator_a_label)) as a, lower(trim(annotator_b_label)) as b from annotation_pairs where case_id is not null),
      sets as (select case_id, count(distinct a) as gold, count(distinct b) as pred from votes group by case_id), hit as (select case_id, count(distinct a) as tp from votes v where exists (select 1 from votes w where w.case_id = v.case_id and w.b = v.a) group by case_id)
      select s.case_id, case when pred = 0 then case when gold = 0 then 1e0 else 0e0 end else round(coalesce(tp, 0) / cast(pred as double), 9) end as precision, case when gold = 0 then 1e0 else round(coalesce(tp, 0) / cast(gold as double), 9) end as recall from sets s left join hit h on s.case_id = h.case_id""",
    "q_consistency": r"""with votes as (select distinct case_id, annotator_a_id as who, lower(trim(annotator_a_label)) as label from annotation_pairs where annotator_a_label is not null and case_id is not null), c as (select case_id, label, count(*) as n from votes group by case_id, label)
      select case_id, round(cast(max(n) as double) / sum(n), 9) as consistency, cast(max(n) as double) / sum(n) < 0.95 as needs_human from c group by case_id""",
    "q_conv_search": r"""select c_custkey, c_name from customer where lower(c_name) like '%9%' or lower(c_mktsegment) like '%build%' order by c_acctbal desc, c_custkey desc limit 20 offset 10""",
    "q_coverage": r"""with cases as (select distinct case_id, task_family, difficulty, split, language, paper_type, prompt, source_id, source_cluster_id, authorization_status, text_fingerprint, usable_for_training from eval_cases) select task_family, difficulty, language, paper_type, count(*) as n from cases group by grouping sets ((task_family), (difficulty), (language), (paper_type))""",
    "q_dash_filter": r"""with cases as (select distinct case_id, task_family, difficulty, split, language, paper_type, prompt, source_id, source_cluster_id, authorization_status, text_fingerprint, usable_for_training from eval_cases) select case_id, task_family, difficulty from cases where (cast(null as string) is null or language = 'x') and difficulty = 'L3' and split = 'test'""",
    "q_dup_keys": r"""select 'training_samples' as t, sample_id as k, count(*) as n from training_samples group by sample_id having count(*) > 1 union all select 'eval_cases', case_id, count(*) from eval_cases group by case_id having count(*) > 1""",
    "q_event_seq": r"""with seq as (select user_id, event_id, ts, event_type, value, props, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n from events) select event_id, user_id, n from seq""",
    "q_events_after": r"""with seq as (select user_id, event_id, ts, event_type, value, props, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n from events) select event_id, user_id, n from seq where n > 10""",
    "q_exact_dups": r"""select md5(text) as digest, min(doc_id) as kept, count(*) as copies from documents where text is not null group by md5(text) having count(*) > 1""",
    "q_ext_sessions": r"""with e as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as prev from events), m as (select user_id, event_id, ts, sum(case when prev is null or ts > prev + interval '6' hour then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e) select user_id, cast(session as bigint) as session, count(*) as events from m group by user_id, session""",
    "q_failure_members": r"""with scores as (select distinct * from case_scores), f as (select coalesce(system_id, 'system') as category, case_id, count(*) as n from scores where not task_success group by coalesce(system_id, 'system'), case_id),
      t as (select category, cast(sum(n) as bigint) as failures from f group by category)
      select f.category, f.case_id, f.n, t.failures from f join t on f.category = t.category""",
    "q_group_count": r"""select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(12,2))) as double) as quantity from lineitem group by l_returnflag, l_linestatus""",
    "q_idempotent": r"""select min(event_id) as event_id, user_id, event_type, cast(cast(date_trunc('day', ts) as date) as string) as day from events group by user_id, event_type, cast(date_trunc('day', ts) as date)""",
    "q_index_freshness": r"""select c.file_id, count(*) as chunks, count(case when c.indexed_at < r.rendered_at then 1 end) as stale, max(c.indexed_at) >= max(r.rendered_at) as fresh from (select distinct chunk_id, file_id, indexed_at from chunks) c join (select distinct file_id, rendered_at from render_samples) r on c.file_id = r.file_id group by c.file_id""",
    "q_join_anti": r"""select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')""",
    "q_join_inner": r"""select o.o_orderkey, c.c_name, n.n_name from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where c.c_acctbal > 0 and o.o_orderstatus = 'F'""",
    "q_join_left": r"""select c.c_custkey, coalesce(max(o.o_orderpriority), c.c_mktsegment) as label, count(o.o_orderkey) as orders from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey, c.c_mktsegment""",
    "q_join_semi": r"""select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "q_kappa": r"""with v as (select distinct * from annotation_pairs), pairs as (select lower(trim(annotator_a_label)) as a, lower(trim(annotator_b_label)) as b from v where annotator_a_label is not null and annotator_b_label is not null),
      n as (select count(*) as n, count(case when a = b then 1 end) as same from pairs), ma as (select a as label, count(*) as c from pairs group by a), mb as (select b as label, count(*) as c from pairs group by b),
      pe as (select sum(cast(ma.c as double) * mb.c) as s from ma join mb on ma.label = mb.label)
      select n.n as items, round(cast(same as double) / n, 9) as observed, round(case when s / n / n = 1 then case when same = n then 1e0 else 0e0 end else (cast(same as double) / n - s / n / n) / (1 - s / n / n) end, 9) as kappa from n cross join pe""",
    "q_macro_ratio": r"""select o_orderpriority, round(avg(cast(o_totalprice as double) / nullif(l.n, 0)), 4) as macro, count(*) - count(l.n) as excluded from orders o left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey group by o_orderpriority""",
    "q_micro_vs_macro": r"""with per as (select l_orderkey, count(case when l_returnflag = 'R' then 1 end) as num, count(*) as den from lineitem group by l_orderkey)
      select o.o_orderstatus, round(cast(sum(num) as double) / sum(den), 9) as micro, round(avg(cast(num as double) / den), 9) as macro from orders o join per on o.o_orderkey = per.l_orderkey group by o.o_orderstatus""",
    "q_ordered_distinct": r"""select user_id, event_type, min(event_id) as first_id from events group by user_id, event_type""",
    "q_paired_join": r"""with scores as (select distinct * from case_scores), per as (select case_id, system_id, avg(latency_ms) as v from scores where latency_ms > 0 and system_id is not null group by case_id, system_id)
      select a.case_id, a.v as baseline, b.v as candidate, round(b.v - a.v, 6) as delta from per a join per b on a.case_id = b.case_id where a.system_id = 'single_agent' and b.system_id = 'full_system' and a.v is not null and b.v is not null""",
    "q_param_validity": r"""with scores as (select distinct * from case_scores) select system_id, count(case when task_success then 1 end) as valid, count(task_success) as known, round(cast(count(case when task_success then 1 end) as double) / nullif(count(task_success), 0), 9) as rate from scores group by system_id""",
    "q_per_success": r"""with scores as (select distinct * from case_scores) select system_id, round(cast(sum(total_tokens) as double) / nullif(count(case when task_success then 1 end), 0), 6) as per_success, round(avg(case when task_success then total_tokens end), 6) as mean_of_successes from scores where total_tokens is not null group by system_id""",
    "q_percentiles": r"""with scores as (select distinct * from case_scores) select system_id, percentile_cont(0.5) within group (order by latency_ms) as p50, percentile_cont(0.95) within group (order by latency_ms) as p95 from scores where latency_ms > 0 group by system_id""",
    "q_recent": r"""select user_id, event_id, ts from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) t where r <= 5""",
    "q_refcount": r"""select l_partkey as part, count(distinct l_orderkey) as refs from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderstatus <> 'F' group by l_partkey""",
    "q_reindex_stale": r"""select distinct c.chunk_id, c.file_id from chunks c join render_samples r on c.file_id = r.file_id where c.indexed_at < r.rendered_at or c.text is null""",
    "q_segment_sources": r"""with seq as (select user_id, event_id, ts, event_type, value, props, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n from events) select user_id, cast(floor((n - 1) / 12) as bigint) as segment, min(event_id) as first_id, max(event_id) as last_id, count(*) as members from seq group by user_id, cast(floor((n - 1) / 12) as bigint)""",
    "q_set_ops": r"""select 'both' as part, count(*) as n from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') x
      union all select 'only_f', count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O') y""",
    "q_slices": r"""with scores as (select distinct * from case_scores), joined as (select s.system_id, c.difficulty, c.task_family, s.task_success from scores s join (select distinct case_id, difficulty, task_family from eval_cases) c on s.case_id = c.case_id where s.system_id is not null)
      select system_id, difficulty, task_family, cast(grouping(difficulty) as int) as all_difficulties, cast(grouping(task_family) as int) as all_families, count(*) as n, round(avg(case when task_success then 1e0 when not task_success then 0e0 end), 9) as success
      from joined group by grouping sets ((system_id), (system_id, difficulty), (system_id, task_family))""",
    "q_top_failures": r"""with scores as (select distinct * from case_scores) select coalesce(system_id, 'system') as category, count(*) as n from scores where not task_success group by coalesce(system_id, 'system') order by n desc, category limit 3""",
    "q_union": r"""select s_suppkey as id, s_name as name, 'supplier' as kind from supplier union all select c_custkey, c_name, 'customer' from customer""",
    "q_until_terminal": r"""with seq as (select user_id, event_id, ts, event_type, value, props, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n from events), t as (select user_id, min(n) as stop from seq where event_type = 'purchase' group by user_id) select s.event_id, s.user_id, s.n from seq s left join t on s.user_id = t.user_id where t.stop is null or s.n <= t.stop""",
    "q_usage_pivot": r"""with scores as (select distinct * from case_scores) select case_id, cast(coalesce(sum(case when system_id in ('frozen_small', 'single_agent') then total_tokens end), 0) as bigint) as small,
      cast(coalesce(sum(case when system_id in ('full_system', 'verifier') then total_tokens end), 0) as bigint) as large,
      cast(coalesce(sum(case when system_id in ('frozen_small', 'single_agent', 'full_system', 'verifier') then total_tokens end), 0) as bigint) as total from scores where case_id is not null group by case_id""",
    "q_weighted_rank": r"""with rule as (select p_partkey, p_type, p_size, max(p_size) over (partition by p_type) as top, p_retailprice / max(p_retailprice) over (partition by p_type) as sim from part),
      scored as (select p_partkey, p_type, round(0.65 * case when top = 0 then 0 else cast(p_size as double) / top end + 0.35 * greatest(0, sim), 9) as score from rule)
      select p_partkey, p_type, score, rank from (select *, cast(row_number() over (partition by p_type order by score desc, p_partkey) as bigint) as rank from scored) t where rank <= 3""",
}
