"""Queries over rule-based text functions and scholarly records, and the same in SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import rules as X
from papyrine.functions import text as TX
from papyrine.functions import vectorized as V
from papyrine.operators import works as W
from papyrine.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def asked(spark, d):
    """Distinct requests (case_id, prompt)."""
    return table(spark, d, "eval_cases").where("prompt is not null").select("case_id", "prompt").distinct()


def _terms(spark, d, terms):
    return docs(spark, d).select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def q_memory_terms(spark, d):
    return _terms(spark, d, X.memory_terms)


def q_meaningful_terms(spark, d):
    return _terms(spark, d, X.meaningful_terms)


def q_content_terms(spark, d):
    return _terms(spark, d, X.content_terms)


def q_invariants(spark, d):
    found = docs(spark, d).select("doc_id", X.invariants(F.col("text")).alias("i"))
    return found.select("doc_id", *[F.array_join(F.array_sort(F.col("i")[k]), "|").alias(k) for k in ("numbers", "formulas", "citations")])


def q_inline_citations(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(X.inline_citations(F.col("text")), "|").alias("cited"))


def q_nfkc(spark, d):
    return docs(spark, d).select("doc_id", F.md5(V.nfkc_casefold("text")).alias("digest"))


def q_token_estimate(spark, d):
    return docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def q_case_seed(spark, d):
    return table(spark, d, "eval_cases").where("case_id is not null").select("case_id").distinct().select("case_id", X.case_seed(17, F.col("case_id")).cast("string").alias("seed"))


def q_injection_guard(spark, d):
    found = docs(spark, d).select("doc_id", X.injection_guard(F.col("text")).alias("g"))
    return found.select("doc_id", F.size("g.matches").cast("bigint").alias("matches"), "g.risk", "g.allowed", F.md5("g.cleaned").alias("cleaned"))


def q_redact_json(spark, d):
    """Requests of training samples with the contents of sensitive keys hashed, at any depth."""
    return table(spark, d, "training_samples").where("sample_id is not null").select("sample_id", "input").distinct().select("sample_id", X.redact_json()("input").alias("input"))


def q_canonical_json(spark, d):
    return table(spark, d, "training_samples").where("sample_id is not null").select("sample_id", "sft_target").distinct().select("sample_id", X.canonical_sha256("sft_target").alias("sha256"))


def codes(spark, d):
    """Error codes of failed runs: the type of event with its key."""
    return table(spark, d, "events").select("event_id", F.concat(F.element_at(F.array(*[F.lit(c) for c in ("route_miss", "plan_dep", "rag_empty", "tool_invalid_args", "generation_x", "VERIFY_x", " dataset_x", "timeout", "odd", "skill_none", "citation_bad")]), (F.col("event_id") % 11 + 1).cast("int")), F.lit("_"), F.col("event_type")).alias("code"))


def q_error_class(spark, d):
    return codes(spark, d).select("event_id", X.error_category(F.col("code")).alias("error_class"))


def q_field_detection(spark, d):
    """Passages whose first word is set before them as a field's name: the field, and the value without it."""
    names = F.array(*[F.lit(p) for _, ps in X.FIELD_PREFIXES for p in ps], F.lit("note:"))
    passage = F.concat(F.lit(" "), F.initcap(F.element_at(names, (F.col("doc_id") % 17 + 1).cast("int"))), F.lit(" "), F.substring("text", 1, 60))
    return docs(spark, d).select("doc_id", X.field_of(passage).alias("field"), F.md5(X.field_value(passage)).alias("value"))


def q_route_flags(spark, d):
    flags = X.routes(F.col("prompt"))
    return asked(spark, d).select("case_id", *[c.alias(n) for n, c in flags.items()])


def q_bare_query(spark, d):
    """Requests as searches: each once as it is and once in a wrapper."""
    rows = asked(spark, d).select("case_id", F.explode(F.array(F.col("prompt"), F.concat(F.lit("Please find some papers about "), F.col("prompt")), F.concat(F.lit("请帮我查找一些关于"), F.col("prompt"), F.lit("的相关论文？")))).alias("q"))
    return rows.select("case_id", F.md5(X.bare_query(F.col("q"))).alias("digest"))


def q_requirement(spark, d):
    n = F.length("prompt")
    rows = asked(spark, d).select("case_id", X.requirement(F.col("prompt"), n % 3, n % 5 == 0, n % 7 == 0, n % 11 == 0).alias("r"))
    return rows.select("case_id", "r.task", "r.relation", "r.source", "r.memory", "r.skill", "r.confidence", F.array_join("r.missing", ",").alias("missing"))


def q_constraints(spark, d):
    rows = asked(spark, d).select("case_id", F.concat(F.col("prompt"), F.lit(" a.pdf"), F.when(F.length("prompt") % 2 == 0, " B-2.PDF a.pdf")).alias("p"), "prompt")
    rows = rows.select("case_id", X.constraints(F.coalesce("p", "prompt")).alias("c"))
    return rows.select("case_id", F.array_join(F.array_sort("c.sources"), ",").alias("sources"), "c.language", "c.focus", F.array_join("c.missing", ",").alias("missing"))


def q_preflight(spark, d):
    t = table(spark, d, "training_samples").where("sample_id is not null").select("sample_id", "task_type", F.coalesce(F.size("paper_ids"), F.lit(0)).alias("files"), F.col("input").isNotNull().alias("inline"), (F.coalesce(F.size("conversation_ids"), F.lit(0)) > 0).alias("talk")).distinct()
    problem = X.input_problem(F.greatest("files", F.lit(0)), F.when(F.col("task_type") == "claim_check", 1).otherwise(0), F.lit(3), F.col("task_type") != "router", {"inline_text": F.col("inline"), "conversation_material": F.col("talk")}, F.when(F.col("task_type") == "claim_check", F.array(F.lit("conversation_material"))).otherwise(F.array(F.lit("inline_text"), F.lit("conversation_material"))))
    return t.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


def q_subset_filter(spark, d):
    """Samples as skills that may be offered: source permitted, papers among those with an even last digit or none, at most two
    conversations, and no barring phrase in the request."""
    t = table(spark, d, "training_samples").where("sample_id is not null").select("sample_id", "source", "paper_ids", "conversation_ids", "input").distinct()
    papers = F.filter(F.coalesce("paper_ids", F.array().cast("array<string>")), lambda p: p.isNotNull())
    even = F.filter(papers, lambda p: F.substring(p, -1, 1).isin("0", "2", "4", "6", "8"))
    ok = X.eligible(F.col("source"), papers, F.lit(2), F.array(F.lit("ONLY IF"), F.lit("please")), F.coalesce("input", F.lit("")), F.transform(F.array(F.col("source")), lambda s: F.when(F.length(s) > 4, s)), even, F.size(F.coalesce("conversation_ids", F.array().cast("array<string>"))))
    return t.where(ok).select("sample_id")


def q_safe_names(spark, d):
    t = table(spark, d, "render_samples").where("path is not null").select("file_id", "path").distinct()
    return t.select("file_id", "path", X.safe_name(F.col("path")).alias("name"), X.safe_key(F.concat(F.lit("files/"), F.col("path")), ["files"]).alias("key"))


def q_ratio_rules(spark, d):
    t = table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("b")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    a, b = (F.col("o_orderkey") % 7), F.coalesce("b", F.lit(0))
    return t.select("o_orderkey", F.round(X.ratio_or_null(a, b), 9).alias("metric"), F.round(X.ratio_or_one(a, b), 9).alias("completion"), F.round(X.ratio_at_least(a, b), 9).alias("retrieval"))


def q_padded(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", X.padded(F.col("embedding"), 100).alias("long"), X.padded(F.col("embedding"), 10).alias("short"))
    return e.select("vec_id", F.size("long").cast("bigint").alias("n_long"), F.size("short").cast("bigint").alias("n_short"), F.round(F.element_at("short", 10), 6).alias("last"), F.element_at("long", 100).alias("tail"))


def _works(spark, d):
    """Documents as works of several registries: every third with its DOI as an address, every third with it in capitals."""
    t = table(spark, d, "documents").where("text is not null")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/"), F.trim("paper_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("10.1234/"), F.upper(F.trim("paper_id")))).otherwise(F.lit("none"))
    year = F.when(F.col("doc_id") % 4 > 0, F.date_format("created_at", "yyyy"))
    return t.select("doc_id", "source", F.substring("text", 1, 40).alias("title"), X.doi(raw).alias("doi"), X.nullable_int(F.coalesce(year, F.lit(" "))).alias("year"), "lang", F.col("n_chars").alias("citation_count"))


def q_work_keys(spark, d):
    return _works(spark, d).select("doc_id", "doi", "year", F.md5(F.coalesce(W.work_key(F.col("doi"), F.col("title")), F.lit("-"))).alias("key"))


def q_record_merge(spark, d):
    merged = W.merge_works(_works(spark, d), "doc_id", ["year", "lang"])
    return merged.select(F.md5("key").alias("key"), F.md5("title").alias("title"), "doi", "year", "lang", "citation_count", F.array_join("sources", ",").alias("sources"), "works")


def q_ranked_works(spark, d):
    merged = W.merge_works(_works(spark, d), "doc_id", ["year", "lang"])
    return W.ranked_works(merged, 50).select(F.md5("key").alias("key"), "citation_count", "year")


def q_nullable_int(spark, d):
    """Chunk numbers, broken in several ways, as whole numbers or null."""
    t = table(spark, d, "render_samples").select("file_id", "page_count").distinct()
    raw = F.concat(F.element_at(F.array(*[F.lit(x) for x in (" ", "+", "-", "x", "")]), (F.coalesce("page_count", F.lit(0)) % 5 + 1).cast("int")), F.coalesce(F.col("page_count").cast("string"), F.lit("")), F.lit(" "))
    return t.select("file_id", "page_count", X.nullable_int(raw).alias("parsed"))


QUERIES = {f.__name__: f for f in (q_memory_terms, q_meaningful_terms, q_content_terms, q_invariants, q_inline_citations, q_nfkc, q_token_estimate, q_case_seed, q_injection_guard, q_redact_json, q_canonical_json, q_error_class, q_field_detection, q_route_flags, q_bare_query, q_requirement, q_constraints, q_preflight, q_subset_filter, q_safe_names, q_ratio_rules, q_padded, q_work_keys, q_record_merge, q_ranked_works, q_nullable_int)}

_D = "d as (select doc_id, text from documents where text is not null)"
_A = "a as (select distinct case_id, prompt from eval_cases where prompt is not null)"


def _words(pattern: str, stop: str = "") -> str:
    kept = f"list_filter(regexp_extract_all(lower(text), '{pattern}'), lambda t: not list_contains([{stop}], t))" if stop else f"regexp_extract_all(lower(text), '{pattern}')"
    return f"with {_D}, t as (select doc_id, {kept} as t from d) select doc_id, len(t) as n, md5(array_to_string(t, ' ')) as digest from t"


_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_INJ = (
    "(?i)ignore (?:all |the )?(?:previous|system) instructions?", "(?i)reveal (?:the )?(?:system prompt|secret|api key)", "(?i)(?:call|use|invoke) (?:the )?(?:tool|shell|terminal)",
    "(?i)(?:delete|exfiltrate|upload|send) (?:all |the )?(?:files|data|paper)", "(?i)你(?:现在)?(?:必须|应该).*(?:忽略|泄露|调用工具|删除)", "(?i)忽略(?:之前|系统|所有).*(?:指令|规则|提示)", r"(?i)(?:system|developer)[ \t\n\f\r\x0b]*:[ \t\n\f\r\x0b]*",
)
_clean = "text"
for _p in _INJ:
    _clean = f"regexp_replace({_clean}, '{_p}', '[BLOCKED_UNTRUSTED_INSTRUCTION]', 'g')"
_m = lambda p: f"regexp_matches(prompt, '(?i){p}')"
_WK = r"""w as (select doc_id, source, substring(text, 1, 40) as title, lang, n_chars as citation_count,
  case when doc_id % 4 > 0 then cast(year(created_at) as bigint) end as year,
  case doc_id % 3 when 0 then 'https://doi.org/10.1234/' || trim(paper_id, ' ') when 1 then '10.1234/' || upper(trim(paper_id, ' ')) else 'none' end as raw from documents where text is not null),
v as (select *, case when regexp_full_match(trim(regexp_replace(raw, '^https?://(dx\.)?doi\.org/', ''), ' '), '10\.\d{4,9}/\S+') then lower(trim(regexp_replace(raw, '^https?://(dx\.)?doi\.org/', ''), ' ')) end as doi,
  regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}_]+', '', 'g') as tk from w),
k as (select *, case when tk <> '' then case when doi is not null then 'doi:' || doi else 'title:' || tk end end as key from v)"""
_MERGED = _WK + """, m as (select key, arg_min(title, doc_id) as title, arg_min(doi, doc_id) filter (where doi <> '') as doi, arg_min(year, doc_id) filter (where year is not null) as year, arg_min(lang, doc_id) filter (where lang <> '') as lang,
  max(citation_count) as citation_count, array_to_string(list_sort(list(distinct source) filter (where source is not null)), ',') as sources, count(*) as works from k where key is not null group by key)"""

SQL = {
    "q_memory_terms": _words(r"[\p{L}\p{N}\p{M}_]+"),
    "q_meaningful_terms": _words(r"[a-z0-9%]+|[\x{4e00}-\x{9fff}]{2,}", _quoted("the a an is are was were what which how does did of in to and 该 的 是 什么 如何".split())),
    "q_content_terms": _words(r"[a-z0-9%]+|[\x{4e00}-\x{9fff}]{2,}", _quoted("the a an is are and of to 这些 进行 结果".split())),
    "q_invariants": rf"""with {_D}, f as (select doc_id, regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])([0-9]+(?:\.[0-9]+)?%?)', 1) as n, regexp_extract_all(text, '\$[^$]+\$|\\\([^)]*\\\)|\\\[[^\]]*\\\]') as f, regexp_extract_all(text, '\[[A-Za-z]?[0-9]+(?:[-,]\s*[A-Za-z]?[0-9]+)*\]') as c from d)
      select doc_id, array_to_string(list_sort(list_distinct(n)), '|') as numbers, array_to_string(list_sort(list_distinct(f)), '|') as formulas, array_to_string(list_sort(list_distinct(c)), '|') as citations from f""",
    "q_inline_citations": rf"with {_D} select doc_id, array_to_string(regexp_extract_all(text, '\[([A-Za-z][\p{{L}}\p{{N}}_]*)\]', 1), '|') as cited from d",
    "q_token_estimate": f"with {_D} select doc_id, (length(text) + 3) // 4 as tokens from d",
    "q_case_seed": "select distinct case_id, cast(cast('0x' || sha256('17:' || case_id)[1:16] as ubigint) as varchar) as seed from eval_cases where case_id is not null",
    "q_injection_guard": f"with {_D}, g as (select doc_id, text, {' + '.join(f'''len(regexp_extract_all(text, '{p}'))''' for p in _INJ)} as n from d) select doc_id, n as matches, least(1.0, n / 2.0)::double as risk, n = 0 as allowed, md5({_clean}) as cleaned from g",
    "q_error_class": """with c as (select event_id, lower(trim((['route_miss','plan_dep','rag_empty','tool_invalid_args','generation_x','VERIFY_x',' dataset_x','timeout','odd','skill_none','citation_bad'])[event_id % 11 + 1] || '_' || event_type, ' ')) as c from events)
      select event_id, case when regexp_matches(c, '^(route|routing|skill_)') then 'routing' when regexp_matches(c, '^(plan|invalid_plan|dependency|budget_plan)') then 'planning' when regexp_matches(c, '^(rag|retriev|evidence_not_found)') then 'retrieval'
        when regexp_matches(c, '^(tool_invalid|tool_argument|schema_tool)') then 'tool_parameters' when regexp_matches(c, '^(generation|unsupported_claim|hallucination)') then 'generation' when regexp_matches(c, '^(verif|citation_|invariant_)') then 'verification'
        when regexp_matches(c, '^(data|invalid_gold|dataset|source_)') then 'data' else 'system' end as error_class from c""",
    "q_field_detection": f"""with {_D}, p as (select doc_id, ['title','title','research_question','research_question','methodology','methodology','methodology','datasets','datasets','datasets','metrics','metrics','metrics','results','results','results','contributions'][doc_id % 17 + 1] as field, trim(substring(text, 1, 60), ' ') as v from d)
      select doc_id, field, md5(v) as value from p""",
    "q_route_flags": rf"""with {_A}, b as (select *, regexp_replace(prompt, '\s+', '', 'g') as bare from a)
      select case_id, {_m("刚才|之前|前面|上面|上述|这个|那个|它|其|该|继续|接着|进一步|为什么|还有|再说|展开|详细一点|列举|举例|逐一|逐个|分别说明|具体有哪些|都有哪些|what about|continue|previous")} or (length(bare) <= 40 and regexp_matches(bare, '(呢|又如何|怎么样|如何|怎样|多少|哪些|是什么)[？?]?$')) as follow_up,
        length(trim(prompt, ' ')) >= 100 or {_m("(帮我|请|现在).{0,12}(润色|改写|重写|总结|比较|检索|查找)|polish|rewrite|find papers|search papers")} as new_task,
        {_m("以前|历史|过去|之前的会话|其他会话|另一个会话|跨会话|曾经|上次聊|remember|previous conversation|earlier chat")} as long_memory, {_m("比较|对比|综述|综合|review|compare|synthesize")} as several,
        {_m("crossref|semantic scholar|openalex|arxiv")} or ({_m(r"(找|查找|搜索|检索|推荐).{0,48}(论文|文献|paper)|(论文|文献).{0,10}(推荐|搜索|检索)|\b(find|search|recommend)\b.{0,32}\bpapers?\b|\bpapers?\s+(about|on|related to)\b|literature search")} and not {_m("这篇论文|本文|已上传|上传的|附件|pdf 中|文档中")}) as discovery from b""",
    "q_bare_query": rf"""with {_A}, q as (select case_id, unnest([prompt, 'Please find some papers about ' || prompt, '请帮我查找一些关于' || prompt || '的相关论文？']) as q from a), c as (select case_id, q, trim(regexp_replace(q, '\s+', ' ', 'g'), ' ') as c from q),
      s as (select case_id, q, trim(regexp_replace(regexp_replace(regexp_replace(c, '^(请|请你)?(帮我|给我)?(查找|找|搜索|检索|推荐)(一下|一些|几篇)?(关于)?', ''), '(?i)^(please\s+)?(find|search(\s+for)?|recommend)\s+(some\s+)?papers?\s+(about|on)?\s*', ''), '(的)?(相关)?(论文|文献)[？?。.!]*$', ''), ' ') as s from c)
      select case_id, md5(case when length(s) >= 2 then s else trim(q, ' ') end) as digest from s""",
    "q_requirement": rf"""with {_A}, b as (select case_id, trim(prompt, ' ') as prompt, length(prompt) % 3 as files, length(prompt) % 5 = 0 as inline, length(prompt) % 7 = 0 as talk, length(prompt) % 11 = 0 as pending from a),
      t as (select *, case when {_m("润色|改写|重写|优化表述|调整表达|语言优化|学术化|衔接|融入|polish|rewrite|paraphrase")} then 'academic_rewrite' when {_m("(检索|查找|搜索|推荐|寻找).{0,12}(论文|文献)|(论文|文献).{0,12}(检索|查找|搜索|推荐|寻找)|crossref|arxiv|openalex|semantic scholar")} then 'paper_discovery'
        when {_m("比较|对比|异同|compare")} then 'paper_comparison' when {_m("综述|综合多篇|literature review")} then 'literature_synthesis' when {_m("总结|摘要|概括|summar")} then 'document_summary' when {_m("主张|论断|核验|引用|claim")} then 'claim_analysis'
        when files > 0 or {_m("论文|文章|章节|实验|方法|数据集")} then 'document_qa' else 'general_answer' end as task,
        case when pending and length(prompt) < 80 then 'answer_clarification' when {_m("继续|接着|刚才|之前|前面|上面|上述|那段|上一版|再润色|再改|continue|previous")} then 'continue_previous' else 'new_task' end as relation from b),
      s as (select *, case when task = 'academic_rewrite' and inline then 'inline_text' when task = 'paper_discovery' then 'external' when files > 0 then 'uploaded_files' when task = 'academic_rewrite' and talk then 'conversation_material' else 'none' end as source from t)
      select case_id, task, relation, source, case when task = 'academic_rewrite' then case when source = 'conversation_material' then 'specific_material' else 'none' end when task <> 'paper_discovery' and relation <> 'new_task' then 'recent_context' else 'none' end as memory,
        case task when 'academic_rewrite' then 'academic_rewriter' when 'paper_discovery' then 'paper_discovery' when 'paper_comparison' then 'comparison_analyzer' when 'literature_synthesis' then 'literature_synthesizer' when 'document_summary' then 'summary_generator' when 'claim_analysis' then 'claim_verifier' else 'paper_reader' end as skill,
        case task when 'academic_rewrite' then 0.92 when 'paper_discovery' then 0.9 else 0.75 end::double as confidence, case when task = 'academic_rewrite' and source = 'none' then 'source_text' else '' end as missing from s""",
    "q_constraints": r"""with a as (select distinct case_id, prompt from eval_cases where prompt is not null), p as (select case_id, case when length(prompt) % 2 = 0 then prompt || ' a.pdf B-2.PDF a.pdf' else prompt end as p from a), s as (select case_id, p, list_sort(list_distinct(regexp_extract_all(p, '(?i)[\p{L}\p{N}_.\-]+\.pdf'))) as s from p)
      select case_id, array_to_string(s, ',') as sources, case when contains(p, '中文') then 'zh' end as language, case when contains(p, '方法和实验') then '方法和实验' when contains(p, '方法') then '方法' when contains(p, '实验') then '实验' end as focus,
        array_to_string(list_filter([case when not regexp_matches(p, '总结|比较|提取|验证|分析|改写|翻译') then 'goal' end, case when len(s) = 0 then 'source' end, case when contains(p, '比较') and len(s) < 2 then 'comparison_sources' end], lambda x: x is not null), ',') as missing from s""",
    "q_preflight": """with t as (select distinct sample_id, task_type, coalesce(len(paper_ids), 0) as files, input is not null as inline, coalesce(len(conversation_ids), 0) > 0 as talk from training_samples where sample_id is not null),
      p as (select case when files < case when task_type = 'claim_check' then 1 else 0 end then 'uploaded_files' when files > 3 then 'too_many_files' when task_type = 'router' or task_type is null then 'ok' when task_type = 'claim_check' and talk then 'ok' when task_type <> 'claim_check' and (inline or talk) then 'ok' else 'source_material' end as problem from t)
      select problem, count(*) as n from p group by problem""",
    "q_subset_filter": """with t as (select distinct sample_id, source, paper_ids, conversation_ids, input from training_samples where sample_id is not null)
      select sample_id from t where (source is null or length(source) > 4) and len(list_filter(coalesce(paper_ids, []), lambda p: p is not null and right(p, 1) not in ('0', '2', '4', '6', '8'))) = 0 and len(coalesce(conversation_ids, [])) <= 2 and not regexp_matches(lower(coalesce(input, '')), 'only if|please')""",
    "q_safe_names": r"""select distinct file_id, path, regexp_full_match(path, '[\p{L}\p{N}_.\-]+') as name, not list_contains(string_split(path, '/'), '..') and len(list_filter(string_split(path, '/'), lambda p: p not in ('', '.'))) >= 1 as key from render_samples where path is not null""",
    "q_ratio_rules": """with b as (select l_orderkey, count(*) as b from lineitem where l_returnflag = 'R' group by l_orderkey), r as (select o_orderkey, o_orderkey % 7 as a, coalesce(b, 0) as b from orders left join b on o_orderkey = l_orderkey)
      select o_orderkey, round(cast(a as double) / nullif(b, 0), 9) as metric, case when b = 0 then 1.0 else round(cast(a as double) / b, 9) end as completion, round(cast(a as double) / case when b = 0 then 1 else b end, 9) as retrieval from r""",
    "q_padded": "select vec_id, cast(100 as bigint) as n_long, cast(10 as bigint) as n_short, round(coalesce(cast(embedding[10] as double), 0.0), 6) as last, coalesce(cast(embedding[100] as double), 0.0) as tail from embeddings where embedding is not null",
    "q_work_keys": f"with {_WK} select doc_id, doi, year, md5(coalesce(key, '-')) as key from k",
    "q_record_merge": f"with {_MERGED} select md5(key) as key, md5(title) as title, doi, year, lang, citation_count, sources, works from m",
    "q_ranked_works": f"with {_MERGED} select md5(key) as key, citation_count, year from m order by coalesce(nullif(citation_count, 0), -1) desc, coalesce(nullif(year, 0), -1) desc, m.key limit 50",
    "q_nullable_int": "select distinct file_id, page_count, case when page_count is null then null when page_count % 5 = 2 then -page_count when page_count % 5 = 3 then null else page_count end::bigint as parsed from render_samples",
}
