"""Queries over checks of answers against evidence, and the same in SQL written on its own. Search queries are taken as answers, the
files they hit as claims, the chunks hit as evidence; chunks' first words name fields of papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import rules as X
from papyrine.functions.text import retrieval_terms
from papyrine.operators import metrics as M
from papyrine.operators import verification as E
from papyrine.operators.windows import numbered
from papyrine.sources.tables import table

ONCE, MANY = ("title", "methodology"), ("datasets", "metrics", "results")


def _empty():
    return F.array().cast("array<string>")


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang", "source", "paper_id")


def hits(spark, d):
    return table(spark, d, "search_hits").where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id", "file_id").distinct()


def chunks(spark, d):
    return table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("file_id").alias("file_id"), F.min("page_start").alias("page_start"), F.min("text").alias("text"))


def passages(spark, d):
    """Chunks as passages of a field that the last digit of their key names; the value is the first line, the quote the text's first half."""
    names = F.array(*[F.lit(x) for x in (*ONCE, *MANY, *ONCE, *MANY)])
    c = chunks(spark, d).where("file_id is not null and text is not null")
    digit = F.substring("chunk_id", -1, 1).cast("int")
    return c.where("substring(chunk_id, -2, 1) <> '9'").select("file_id", F.col("chunk_id").alias("evidence_id"), F.get(names, digit).alias("field"), F.substring(F.trim(F.split("text", "\n")[0]), 1, 80).alias("value"), F.expr("substring(text, 1, cast(length(text) / 2 as int))").alias("quote"))


def q_verify(spark, d):
    t = docs(spark, d)
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in ("lang", "source", "paper_id")]))
    v = E.verify_output(F.col("text"), present, F.array(F.lit("lang"), F.lit("source")), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0), F.expr("substring(text, 1, cast(length(text) * 3 / 4 as int))"), F.array(F.lit("C1"), F.lit("A2")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("the"), F.lit("calibration"))).otherwise(_empty()), F.col("doc_id") % 4)
    return t.select("doc_id", v.alias("v")).select("doc_id", "v.status", F.array_join("v.issues", ",").alias("issues"), "v.coverage")


def q_claim_support(spark, d):
    """Each chunk as evidence for the first sentence of its file's first chunk."""
    c = chunks(spark, d).where("file_id is not null and text is not null")
    first = c.groupBy("file_id").agg(F.min_by("text", "chunk_id").alias("t")).select("file_id", F.split("t", r"\. ")[0].alias("claim"))
    s = c.join(first, "file_id").select("chunk_id", E.support(F.col("claim"), F.col("text")).alias("s"))
    return s.select("chunk_id", F.round("s.share", 9).alias("support"), "s.supported")


def q_rewrite_check(spark, d):
    """Documents rewritten by leaving out their last twentieth and one word."""
    new = F.regexp_replace(F.expr("substring(text, 1, cast(length(text) * 19 / 20 as int))"), r" of ", " on ")
    r = docs(spark, d).select("doc_id", E.rewrite_check(F.col("text"), new, F.array(F.lit("We"), F.lit("the"), F.lit("We"))).alias("r"))
    return r.select("doc_id", F.array_join(F.array_sort("r.missing"), "|").alias("missing"), F.round("r.preserved", 9).alias("preserved"), F.round("r.semantic", 9).alias("semantic"), "r.passed")


def q_traceability(spark, d):
    """Claims of each search query are the chunks it hit with the files it names; the matrix are the chunks with a page."""
    draft = hits(spark, d).groupBy(F.col("query_id").alias("draft_id"), F.col("chunk_id").alias("claim_id")).agg(F.collect_set("file_id").alias("refs")).withColumn("inferred", F.substring("claim_id", -1, 1).isin("3", "7"))
    matrix = chunks(spark, d).where("page_start is not null").select(F.col("chunk_id").alias("claim_id"), F.when(F.col("file_id").isNotNull(), F.array("file_id")).otherwise(_empty()).alias("refs"))
    found = E.traceability(draft, matrix)
    return found.groupBy("draft_id", "finding").agg(F.count("*").alias("claims"), F.min("claim_id").alias("first"))


def q_severe_rate(spark, d):
    """Claims of a query are the files it hit, with the chunks hit; chunks with a page are valid."""
    h = hits(spark, d).join(chunks(spark, d).select("chunk_id", "page_start"), "chunk_id", "left")
    claims = h.where("file_id is not null").groupBy("query_id", "file_id").agg(F.collect_set("chunk_id").alias("evidence")).groupBy("query_id").agg(F.collect_list(F.struct("evidence", F.substring("file_id", -1, 1).isin("3", "7").alias("inferred"))).alias("claims"))
    per = h.groupBy("query_id").agg(F.count("*").alias("citations"), F.collect_set(F.when(F.col("page_start") % 3 == 0, F.col("chunk_id"))).alias("valid"))
    a = per.join(claims, "query_id", "left").select(F.col("query_id").alias("answer_id"), "citations", "valid", F.coalesce("claims", F.array().cast("array<struct<evidence:array<string>,inferred:boolean>>")).alias("claims"))
    return E.severe_rate(a).select("answer_id", F.round("rate", 9).alias("rate"))


def q_completion(spark, d):
    h = hits(spark, d)
    c = chunks(spark, d)
    n = F.conv(F.substring(F.md5("case_id"), 1, 6), 16, 10).cast("int")
    base = h.select(F.col("query_id").alias("case_id")).distinct().withColumn("n", n)
    kinds = F.array(*[F.lit(x) for x in ("Compare papers", "write section", "answer", "aggregate")])
    cases = base.select(
        "case_id", (F.col("n") % 17 == 0).alias("empty"), F.array(F.lit("answer"), F.lit("claims")).alias("required"), F.when(F.col("n") % 3 == 0, F.array(F.lit("answer"))).otherwise(F.array(F.lit("answer"), F.lit("claims"), F.lit("x"))).alias("present"),
        F.array(F.concat(F.lit("f-00000000"), F.lpad((F.col("n") % 100).cast("string"), 2, "0"))).alias("mapped"), F.get(kinds, F.col("n") % 4).alias("kind"), (F.col("n") % 4).alias("minimum"), F.when(F.col("n") % 5 > 0, (F.col("n") % 10) / 10.0).alias("quality"), F.when(F.col("n") % 2 == 0, F.lit(0.4)).alias("least_quality"),
        F.concat(F.lit("text "), "case_id").alias("text"), F.array(F.lit("q"), F.lit("1")).alias("terms"), (F.col("n") % 3 == 1).alias("review"), (F.col("n") % 7 == 1).alias("pending"), (F.col("n") % 11 > 0).alias("tool_ok"), (F.col("n") % 13 == 0).alias("ask"), F.when(F.col("n") % 29 == 0, "boom").alias("fatal"), (F.col("n") % 3).alias("repairs"), F.lit(2).alias("most_repairs"), (F.col("n") % 2 == 0).alias("replan"),
    )
    named = h.where("file_id is not null")
    claims = named.select(F.col("query_id").alias("case_id"), F.col("file_id").alias("claim_id"), (F.substring("file_id", -1, 1) != "5").alias("factual")).distinct()
    links = named.select(F.col("query_id").alias("case_id"), F.col("file_id").alias("claim_id"), F.col("chunk_id").alias("evidence_id")).where("substring(evidence_id, -1, 1) <> '8'")
    seen = h.select(F.col("query_id").alias("case_id"), "chunk_id").distinct().join(c, "chunk_id")
    evidence = seen.select("case_id", F.col("chunk_id").alias("evidence_id"), F.col("file_id").alias("source_id"), F.col("page_start").alias("page"), F.col("text").isNotNull().alias("trusted"))
    back = seen.where("file_id is not null").select("case_id", F.col("chunk_id").alias("evidence_id"), F.col("file_id").alias("claim_id"))
    targets = named.select(F.col("query_id").alias("case_id"), F.col("file_id").alias("paper_id")).distinct()
    numerics = named.where("substring(chunk_id, -1, 1) in ('1', '2')").select(F.col("query_id").alias("case_id"), F.col("file_id").alias("claim_id"), F.col("chunk_id").alias("evidence_id"), (F.substring("chunk_id", -2, 1) != "4").alias("verified"))
    r = E.completion(cases, claims, links, evidence, back, targets, numerics)
    return r.select("case_id", "decision", "missing_count", *[F.round(x, 9).alias(x) for x in r.columns if x.endswith(("coverage", "rate"))], F.md5(F.array_join("issues", "|")).alias("issues"))


def answers(spark, d):
    """Cases with two annotators' labels as reference and answer, or their request's two halves where there is none."""
    e = table(spark, d, "eval_cases").where("case_id is not null and prompt is not null").groupBy("case_id").agg(F.min(F.struct("prompt", "task_family", "difficulty")).alias("e"), F.min(F.coalesce("paper_ids", _empty())).alias("papers"))
    a = table(spark, d, "annotation_pairs").where("annotator_a_label is not null and annotator_b_label is not null").groupBy("case_id").agg(F.min(F.struct(F.lower(F.trim("annotator_a_label")).alias("reference"), F.concat(F.col("annotator_b_label"), F.lit(" it is.")).alias("answer"))).alias("a"))
    r = e.join(a, "case_id", "left").select("case_id", "e.*", "papers", "a.reference", "a.answer")
    half = F.expr("substring(prompt, 1, cast(length(prompt) / 2 as int))")
    r = r.withColumn("reference", F.coalesce("reference", half)).withColumn("answer", F.coalesce("answer", F.when(F.length("prompt") % 3 == 0, half).otherwise(F.col("prompt"))))
    gold = F.filter("papers", lambda p: p.isNotNull())
    return r.withColumn("gold", gold).withColumn("cited", F.when(F.length("prompt") % 4 == 0, _empty()).when(F.length("prompt") % 4 == 1, F.array(F.lit("other"))).otherwise(F.slice("gold", 1, 1))).withColumn("needs", F.length("prompt") % 5 > 0)


def q_case_score(spark, d):
    a = answers(spark, d).withColumn("f1", M.token_f1(retrieval_terms(F.col("answer")), retrieval_terms(F.col("reference"))))
    s = a.withColumn("s", E.case_score(F.col("answer"), F.col("reference"), F.col("difficulty"), F.col("f1"), F.col("gold"), F.col("cited"), F.col("needs"))).select("*", "s.correctness", "s.recall", "s.success")
    why = E.failure_category(F.col("task_family"), F.col("success"), F.col("correctness"), F.col("recall"), F.length("prompt") % 6, F.size("gold") > 0, F.col("needs"))
    return s.select("case_id", F.round("correctness", 9).alias("correctness"), F.round("recall", 9).alias("recall"), "success", why.alias("failure"))


def q_judge(spark, d):
    a = answers(spark, d)
    return a.select("case_id", E.judge(F.col("cited"), F.col("gold"), F.col("needs"), F.when(F.length("prompt") % 2 == 0, F.upper("reference")).otherwise(F.col("answer")), F.col("reference")).alias("verdict"))


def q_draft_check(spark, d):
    """Each query as a draft that cites some of its chunks by place."""
    h = hits(spark, d).where("file_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("chunk_id", "file_id"))).alias("h"))
    evidence = F.transform("h", lambda x, i: F.struct(F.concat(F.lit("c"), (i + 1).cast("string")).alias("citation"), x["file_id"].alias("paper")))
    n = F.conv(F.substring(F.md5("query_id"), 1, 6), 16, 10).cast("int")
    cites = F.array_join(F.transform(F.slice(evidence, 1, F.when(F.col("n") % 5 == 0, F.lit(0)).when(F.col("n") % 3 == 0, F.lit(1)).otherwise(F.lit(999))), lambda e: F.concat(F.lit("["), e["citation"], F.lit("] "))), "")
    text = F.concat(cites, F.when(F.col("n") % 7 == 0, "[C777] ").otherwise(""), F.when(F.col("n") % 11 > 0, "f-none").otherwise(""))
    r = h.withColumn("n", n)
    papers = F.array_distinct(F.transform("h", lambda x: x["file_id"]))
    issues = lambda m: F.transform(F.sequence(F.lit(1), F.col("n") % m + 1), lambda i: i.cast("string"))
    problem = E.draft_problem(text, evidence, papers, F.when(F.col("n") % 2 == 0, F.array(F.lit("f-none"))).otherwise(_empty()), issues(2), issues(4))
    return r.select("query_id", F.coalesce(problem, F.lit("ok")).alias("result"))


def q_finding_merge(spark, d):
    """Findings on chunks by hit, the later hit overriding."""
    h = table(spark, d, "search_hits").where("chunk_id is not null and hit_id is not null").select("hit_id", F.col("chunk_id").alias("claim_id"), F.when(F.col("hit_id") % 3 == 0, "citation_mismatch").otherwise("unmarked_inference").alias("finding"), "query_id")
    return E.merge_findings(h, "hit_id")


def q_issues_resolved(spark, d):
    h = hits(spark, d)
    issues = h.select(F.col("query_id").alias("draft_id"), F.col("chunk_id").alias("issue_id")).where("substring(issue_id, -1, 1) in ('1', '2')")
    res = h.select(F.col("query_id").alias("draft_id"), F.col("chunk_id").alias("issue_id"), F.when(F.substring("chunk_id", -2, 1) == "9", "open").otherwise("fixed").alias("status")).where("substring(issue_id, -1, 1) in ('1', '2') and substring(issue_id, -3, 1) <> '7'")
    return E.issues_resolved(issues, res)


def q_paper_card(spark, d):
    c = E.cards(passages(spark, d), ONCE, MANY)
    return c.select("file_id", *[F.md5(x).alias(x) for x in ONCE], *[F.md5(F.array_join(x, "|")).alias(x) for x in MANY], F.array_join("missing", ",").alias("missing"))


def q_comparison_matrix(spark, d):
    return E.comparison(passages(spark, d), [*ONCE, *MANY])


def q_quote_ground(spark, d):
    """First sentences of chunks, and every ninth chunk whole, looked for on the other pages' chunks of their file."""
    c = chunks(spark, d).where("file_id is not null and text is not null and page_start is not null")
    quote = F.when(F.substring("chunk_id", -1, 1) == "9", F.col("text")).otherwise(F.split("text", r"\. ")[0])
    quotes = c.select(F.col("chunk_id").alias("quote_id"), F.col("file_id").alias("doc"), quote.alias("text"))
    sizes = table(spark, d, "chunks").groupBy(F.col("file_id").alias("doc")).agg(F.sum(F.length("text")).alias("body"), F.sum(F.length(quote)).alias("quote"))
    return E.grounded(quotes, c.select(F.col("file_id").alias("doc"), F.col("page_start").alias("page"), "text"), sizes=sizes)


def materials(spark, d):
    t = table(spark, d, "documents").where("paper_id is not null").select(F.trim("paper_id").alias("brief_id"), "doc_id", F.when(F.col("doc_kind") == "review_note", "inference").otherwise("fact").alias("kind"), F.col("source").alias("source_id"), F.when(F.col("text").isNotNull(), F.col("doc_id") % 3).otherwise(0).alias("evidence"), "text")
    return numbered(t, ["brief_id"], ["doc_id"], "position")


def q_evidence_map(spark, d):
    return E.evidence_map(materials(spark, d)).select("doc_id", "statement_id", "allowed_as_fact")


def q_brief_gaps(spark, d):
    m = E.evidence_map(materials(spark, d))
    points = m.select("brief_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.lit(" ")).alias("point")).where("point is not null")
    return E.brief_gaps(m, points).select("brief_id", F.array_join("missing", ",").alias("missing"))


def q_review_draft(spark, d):
    """Reviews of each paper by each source."""
    t = table(spark, d, "documents").where("paper_id is not null and source is not null and text is not null")
    ids = lambda n: F.transform(F.sequence(F.lit(1), (F.col("doc_id") % n).cast("int") + 0), lambda i: F.concat(F.lit("E"), i.cast("string")))
    some = lambda n: F.when(F.col("doc_id") % n == 0, _empty()).otherwise(ids(n))
    r = t.select(F.concat(F.trim("paper_id"), F.lit("/"), "source").alias("review_id"), F.col("doc_id").alias("position"), F.when(F.col("doc_kind") == "review_note", "inference").otherwise("fact").alias("kind"), F.substring("text", 1, 30).alias("text"), some(4).alias("source_ids"), some(3).alias("evidence_ids"))
    return E.review_draft(r).select("review_id", F.md5("draft").alias("draft"), F.array_join("errors", "; ").alias("errors"))


def q_evidence_matrix(spark, d):
    """Each query as a theme over the chunks it hit, in the order of their keys, half of them unknown."""
    h = hits(spark, d)
    themes = h.groupBy(F.col("query_id").alias("theme")).agg(F.array_sort(F.collect_set("chunk_id")).alias("statement_ids")).select(F.lit("all").alias("review_id"), "theme", "statement_ids")
    s = chunks(spark, d).where("page_start % 2 = 0").select(F.lit("all").alias("review_id"), F.col("chunk_id").alias("statement_id"), F.col("file_id").alias("source_id"))
    m = E.themed_evidence(themes, s)
    return m.select("theme", F.col("place").cast("bigint").alias("place"), "statement_id", "source_id")


CONTRACT = {"type": "object", "required": ["request"], "properties": {"request": {"type": "string"}, "locale": {"type": "string", "enum": ["en", "zh"]}, "max_papers": {"type": "integer"}, "messages": {"type": "array", "items": {"type": "object", "required": ["role", "content"]}}}, "additionalProperties": False}


def q_contract(spark, d):
    """Where requests of training samples break the contract."""
    t = table(spark, d, "training_samples").where("sample_id is not null").select("sample_id", "input").distinct()
    return t.select("sample_id", F.array_join(X.contract_problems(CONTRACT)("input"), "; ").alias("problems"))


QUERIES = {f.__name__: f for f in (q_verify, q_claim_support, q_rewrite_check, q_traceability, q_severe_rate, q_completion, q_case_score, q_judge, q_draft_check, q_finding_merge, q_issues_resolved, q_paper_card, q_comparison_matrix, q_quote_ground, q_evidence_map, q_brief_gaps, q_review_draft, q_evidence_matrix, q_contract)}

_H = "h as (select distinct query_id, chunk_id, file_id from search_hits where query_id is not null and chunk_id is not null), c as (select chunk_id, min(file_id) as file_id, min(page_start) as page_start, min(text) as text from chunks where chunk_id is not null group by chunk_id)"
_NUM = r"list_distinct(regexp_extract_all({0}, '(?:^|[^\p{{L}}\p{{N}}_])([0-9]+(?:\.[0-9]+)?%?)', 1))"
_TERM = lambda x, stop: rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9%]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda t: not list_contains({stop}, t)))"
_STOP = repr("the a an is are was were what which how does did of in to and 该 的 是 什么 如何".split())
_STOP2 = repr("the a an is are and of to 这些 进行 结果".split())
_MINUS = "list_filter({0}, lambda x: not list_contains({1}, x))"
_TERMS = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[_.-][a-z0-9]+)*'), flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))"
_ANS = """e0 as (select case_id, min({'p': prompt, 'f': task_family, 'd': difficulty}) as e, min(coalesce(paper_ids, [])) as papers from eval_cases where case_id is not null and prompt is not null group by case_id),
a0 as (select case_id, min({'r': lower(trim(annotator_a_label, ' ')), 'a': annotator_b_label || ' it is.'}) as a from annotation_pairs where annotator_a_label is not null and annotator_b_label is not null group by case_id),
b0 as (select e0.case_id, e.p as prompt, e.f as fam, e.d as lvl, length(e.p) as n, list_filter(papers, lambda p: p is not null) as gold, coalesce(a.r, substring(e.p, 1, length(e.p) // 2)) as ref, coalesce(a.a, case when length(e.p) % 3 = 0 then substring(e.p, 1, length(e.p) // 2) else e.p end) as ans from e0 left join a0 using (case_id)),
an as (select *, case n % 4 when 0 then [] when 1 then ['other'] else gold[1:1] end as cited, n % 5 > 0 as needs, regexp_replace(lower(trim(ans, ' ')), '[.。]+$', '') as ta, regexp_replace(lower(trim(ref, ' ')), '[.。]+$', '') as tr from b0)"""
_PAS = """ps as (select file_id, chunk_id as ev, (['title','methodology','datasets','metrics','results','title','methodology','datasets','metrics','results'])[cast(right(chunk_id, 1) as int) + 1] as field, substring(trim(string_split(text, chr(10))[1], ' '), 1, 80) as value, substring(text, 1, length(text) // 2) as quote
  from c where file_id is not null and text is not null and substring(chunk_id, length(chunk_id) - 1, 1) <> '9')"""
_MAT = "mat as (select trim(paper_id, ' ') as brief_id, doc_id, case when doc_kind = 'review_note' then 'inference' else 'fact' end as kind, source, case when text is not null then doc_id % 3 else 0 end as ev, text, row_number() over (partition by trim(paper_id, ' ') order by doc_id) as pos from documents where paper_id is not null), em as (select *, kind = 'fact' and coalesce(source, '') <> '' and ev > 0 as ok from mat)"
_r = lambda a, b: f"round(case when coalesce({b}, 0) = 0 then 1.0 else coalesce({a}, 0)::double / {b} end, 9)"

SQL = {
    "q_verify": f"""with t as (select doc_id, text, lang, source, substring(text, 1, length(text) * 3 // 4) as src from documents where text is not null), x as (select *, (case when lang is null then 1 else 0 end + case when source is null then 1 else 0 end) as gone, {_MINUS.format(_NUM.format('text'), _NUM.format('src'))} as nums, list_filter(list_distinct(regexp_extract_all(text, '\\[([A-Za-z][\\p{{L}}\\p{{N}}_]*)\\]', 1)), lambda c: c not in ('C1', 'A2')) as cites,
        doc_id % 2 = 0 and (not contains(text, 'the') or not contains(text, 'calibration')) as inv from t), y as (select *, concat_ws(',', case when gone > 0 then 'schema_missing' end, case when doc_id % 5 = 0 then 'unsupported_severe_claim' end, case when src <> '' and len(nums) > 0 then 'number_mismatch' end, case when len(cites) > 0 then 'invalid_citation' end, case when inv then 'invariant_missing' end) as issues from x)
      select doc_id, case when issues = '' then 'passed' when doc_id % 4 >= 2 then 'failed' else 'needs_repair' end as status, issues, (2 - gone) / 2.0::double as coverage from y""",
    "q_claim_support": f"with {_H}, f as (select file_id, string_split(arg_min(text, chunk_id), '. ')[1] as claim from c where file_id is not null and text is not null group by file_id), t as (select chunk_id, {_TERM('claim', _STOP)} as ct, {_TERM('text', _STOP)} as et from c join f using (file_id) where text is not null), s as (select chunk_id, case when len(ct) = 0 then 0.0 else len(list_intersect(ct, et))::double / len(ct) end as s from t) select chunk_id, round(s, 9) as support, s >= 0.8 as supported from s",
    "q_rewrite_check": f"""with t as (select doc_id, text, replace(substring(text, 1, length(text) * 19 // 20), ' of ', ' on ') as new from documents where text is not null), q as (select *, list_concat(list_distinct(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]+(?:\\.[0-9]+)?%?)', 1)), list_distinct(regexp_extract_all(text, '\\$[^$]+\\$|\\\\\\([^)]*\\\\\\)|\\\\\\[[^\\]]*\\\\\\]')), list_distinct(regexp_extract_all(text, '\\[[A-Za-z]?[0-9]+(?:[-,]\\s*[A-Za-z]?[0-9]+)*\\]')), ['We', 'the']) as req, {_TERM('text', _STOP2)} as b, {_TERM('new', _STOP2)} as a from t),
      m as (select *, list_filter(req, lambda r: not contains(new, r)) as miss, least(5.0, len(list_intersect(b, a))::double / greatest(1, len(b)) * 5) as sem from q) select doc_id, array_to_string(list_sort(miss), '|') as missing, round((len(req) - len(miss))::double / len(req), 9) as preserved, round(sem, 9) as semantic, len(miss) = 0 and sem >= 4.5 as passed from m""",
    "q_traceability": f"""with {_H}, dr as (select query_id, chunk_id, list(distinct file_id) filter (file_id is not null) as refs from h group by 1, 2), f as (select query_id as draft_id, dr.chunk_id, case when c.chunk_id is null and right(dr.chunk_id, 1) not in ('3', '7') then 'unmarked_inference' when c.chunk_id is not null and len(list_filter(coalesce(refs, []), lambda r: r is distinct from c.file_id)) > 0 then 'citation_mismatch' end as finding from dr left join c on c.chunk_id = dr.chunk_id and c.page_start is not null)
      select draft_id, finding, count(*) as claims, min(chunk_id) as first from f where finding is not null group by 1, 2""",
    "q_severe_rate": f"""with {_H}, g as (select query_id, file_id, bool_or(coalesce(page_start % 3 = 0, false)) as ok from h left join c using (chunk_id) group by query_id, h.file_id), g2 as (select h.query_id, h.file_id, bool_or(coalesce(c.page_start % 3 = 0, false)) as direct from h left join c on c.chunk_id = h.chunk_id group by 1, 2),
      v as (select distinct h.query_id, h.chunk_id from h join c on c.chunk_id = h.chunk_id where c.page_start % 3 = 0), s as (select h.query_id, h.file_id, max(case when v.chunk_id is not null then 1 else 0 end) as ok from h left join v on v.query_id = h.query_id and v.chunk_id = h.chunk_id where h.file_id is not null group by 1, 2)
      select q.query_id as answer_id, round(coalesce(avg(case when s.file_id is null then null when ok = 0 and right(s.file_id, 1) not in ('3', '7') then 1.0 else 0.0 end), 0.0), 9) as rate from (select distinct query_id from h) q left join s using (query_id) group by q.query_id""".replace("g as (select query_id, file_id, bool_or(coalesce(page_start % 3 = 0, false)) as ok from h left join c using (chunk_id) group by query_id, h.file_id), ", ""),
    "q_completion": f"""with {_H}, k as (select distinct query_id as id, cast('0x' || md5(query_id)[1:6] as int) as n from h), kk as (select *, n % 4 in (0, 3) as cmp, n % 4 = 1 as wr from k), nm as (select * from h where file_id is not null), cl as (select distinct query_id as id, file_id as claim, right(file_id, 1) <> '5' as fact from nm), ln as (select query_id as id, file_id as claim, chunk_id as ev from nm where right(chunk_id, 1) <> '8'),
      ev as (select x.query_id as id, x.chunk_id as ev, c.file_id as src, c.page_start as pg, c.text is not null as tr from (select distinct query_id, chunk_id from h) x join c using (chunk_id)), ev2 as (select *, coalesce(trim(src, ' '), '') <> '' as s_ok, coalesce(pg >= 1, false) as p_ok from ev), good as (select * from ev2 where s_ok and p_ok and tr),
      fl as (select cl.id, cl.claim, ln.ev, g.ev is not null as ok, e.src = cl.claim as linked from cl join ln on ln.id = cl.id and ln.claim = cl.claim left join good g on g.id = ln.id and g.ev = ln.ev left join ev e on e.id = ln.id and e.ev = ln.ev where fact),
      st as (select cl.id, cl.claim, max(case when ok and coalesce(linked, false) then 1 else 0 end) filter (fl.ev is not null) as cov from cl left join fl on fl.id = cl.id and fl.claim = cl.claim where fact group by 1, 2), us as (select id, count(distinct ev) as u from fl where ok and coalesce(linked, false) group by id), gd as (select id, count(*) as g from good group by id),
      nums as (select query_id as id, file_id as claim, chunk_id as ev, substring(chunk_id, length(chunk_id) - 1, 1) <> '4' as ver from nm where right(chunk_id, 1) in ('1', '2')),
      iss as (select id, 'output:non_empty' as i from kk where n % 17 = 0 union select id, 'field:claims' from kk where n % 3 = 0 union select id, 'evidence:' || ev || ':source' from ev2 where not s_ok union select id, 'evidence:' || ev || ':page' from ev2 where not p_ok union select id, 'evidence:' || ev || ':untrusted' from ev2 where not tr
        union select id, 'claim:' || claim || ':missing_evidence' from st where cov is null union select fl.id, 'claim:' || fl.claim || ':invalid_evidence:' || ev from fl join st on st.id = fl.id and st.claim = fl.claim where cov = 0 and not ok union select fl.id, 'claim:' || fl.claim || ':unlinked_evidence:' || ev from fl join st on st.id = fl.id and st.claim = fl.claim where cov = 0 and ok and not coalesce(linked, false)
        union select kk.id, 'evidence:minimum:' || (n % 4) from kk left join us using (id) left join gd using (id) where n % 4 > 0 and coalesce(u, g, 0) < n % 4
        union select kk.id, 'paper:' || t.file_id from kk join (select distinct query_id, file_id from nm) t on t.query_id = kk.id where cmp and not exists (select 1 from good where good.id = kk.id and good.src = t.file_id)
        union select id, 'numeric_claim:' || claim from nums where not ver union select nums.id, 'numeric_claim:' || claim || ':invalid_evidence' from nums where ver and not exists (select 1 from good where good.id = nums.id and good.ev = nums.ev)
        union select kk.id, 'evidence_map:' || claim from kk join cl using (id) where wr and fact and claim <> 'f-00000000' || lpad((n % 100)::varchar, 2, '0') union select id, 'immutable_term:' || t from kk, (select unnest(['q', '1']) as t) ts where wr and not contains('text ' || id, t)
        union select id, 'pending_review' from kk where wr and n % 3 = 1 and n % 7 <> 1 union select id, 'quality:minimum' from kk where n % 2 = 0 and (n % 5 = 0 or (n % 10) / 10.0 < 0.4) union select id, 'user_input:required' from kk where n % 13 = 0 union select id, 'fatal:boom' from kk where n % 29 = 0 union select id, 'tool:failed' from kk where n % 11 = 0),
      ic as (select id, count(*) as m, string_agg(i, '|' order by i) as l from iss group by id), pc as (select id, count(*) as a, count(*) filter (cov = 1) as b from st group by id), pm as (select id, count(*) as a, count(*) filter (claim = 'f-00000000' || lpad((n % 100)::varchar, 2, '0')) as b from kk join cl using (id) where fact group by id),
      pe as (select ev2.id, count(*) as a, count(*) filter (s_ok and p_ok and tr) as b from ev2 group by 1), pt as (select t.query_id as id, count(*) as a, count(*) filter (exists (select 1 from good where good.id = t.query_id and good.src = t.file_id)) as b from (select distinct query_id, file_id from nm) t group by 1), pn as (select id, count(*) as a, count(*) filter (ver) as b from nums group by id)
      select kk.id as case_id, case when n % 29 = 0 then 'fail' when n % 13 = 0 then 'ask_user' when n % 11 = 0 then case when n % 2 = 0 then 'replan' else 'fail' end when coalesce(m, 0) = 0 then 'complete' when n % 3 < 2 then 'repair' when n % 2 = 0 then 'replan' else 'fail' end as decision, coalesce(m, 0) as missing_count,
        case when n % 3 = 0 then 0.5 else 1.0 end::double as schema_coverage, {_r('pc.b', 'pc.a')} as claim_evidence_coverage, {_r('pe.b', 'pe.a')} as valid_evidence_rate, {_r('pt.b', 'pt.a')} as target_paper_coverage, {_r('pn.b', 'pn.a')} as numeric_verification_rate, {_r('pm.b', 'pm.a')} as evidence_map_coverage, md5(coalesce(l, '')) as issues
      from kk left join ic using (id) left join pc using (id) left join pm using (id) left join pe using (id) left join pt using (id) left join pn using (id)""",
    "q_case_score": f"""with {_ANS}, x as (select case_id, t, count(*) as n from (select case_id, unnest({_TERMS.format('ans')}) as t from an) q group by 1, 2), y as (select case_id, t, count(*) as n from (select case_id, unnest({_TERMS.format('ref')}) as t from an) q group by 1, 2), hh as (select case_id, sum(least(x.n, y.n)) as h from x join y using (case_id, t) group by 1), sx as (select case_id, sum(n) as n from x group by 1), sy as (select case_id, sum(n) as n from y group by 1),
      s as (select an.*, case when tr in ('yes', 'no') then case when starts_with(ta, tr) then 1.0 else 0.0 end when lvl = 'L1' then case when contains(ta, tr) then 1.0 else 0.0 end else coalesce(2.0 * h / (sx.n + sy.n), 0.0) end::double as cor, case when len(gold) = 0 then 1.0 else len(list_intersect(list_distinct(gold), cited))::double / len(list_distinct(gold)) end as rec from an left join hh using (case_id) left join sx using (case_id) left join sy using (case_id)),
      u as (select *, cor >= case when tr in ('yes', 'no') or lvl = 'L1' then 1.0 else 0.5 end and (not needs or rec > 0) as ok from s)
      select case_id, round(cor, 9) as correctness, round(rec, 9) as recall, ok as success, case when ok then null when n % 6 = 0 and len(gold) > 0 then 'retrieval' when fam in ('skill_tool_category', 'skill_tool_discipline', 'robustness_clarification') then 'routing' when fam = 'robustness_tool_failure' then 'tool_parameters' when fam in ('robustness_partial_failure', 'robustness_cancellation') then 'planning'
        when fam in ('robustness_prompt_injection', 'robustness_citation_ambiguity') then 'verification' when needs and rec = 0 then 'verification' when cor < 0.5 then 'generation' else 'routing' end as failure from u""",
    "q_judge": f"""with {_ANS}, t as (select *, lower(trim(regexp_replace(case when n % 2 = 0 then upper(ref) else ans end, '\\s+', ' ', 'g'), ' ')) as a, lower(trim(regexp_replace(ref, '\\s+', ' ', 'g'), ' ')) as r from an)
      select case_id, case when len({_MINUS.format('cited', 'gold')}) > 0 or (needs and len(cited) = 0) then 'fail' when a = r then 'pass' when r in ('yes', 'no', 'yes.', 'no.') then 'fail' else 'abstain' end as verdict from t""",
    "q_draft_check": f"""with {_H}, o as (select distinct query_id, chunk_id, file_id from h where file_id is not null), r as (select *, row_number() over (partition by query_id order by chunk_id, file_id) as i from o), k as (select query_id, cast('0x' || md5(query_id)[1:6] as int) as n, count(*) as total, count(distinct file_id) as papers, count(distinct file_id) filter (i <= 1) as p1 from r group by query_id)
      select query_id, case when n % 5 = 0 and n % 7 > 0 then 'missing_inline_citations' when n % 7 = 0 then 'unknown_inline_citations' when n % 3 = 0 and p1 < papers then 'readable_paper_not_cited' when n % 2 = 0 and n % 11 = 0 then 'missing_paper_not_disclosed' when n % 2 <> n % 4 then 'critic_issues_not_resolved' else 'ok' end as result from k""",
    "q_finding_merge": "with f as (select distinct hit_id, chunk_id as claim_id, case when hit_id % 3 = 0 then 'citation_mismatch' else 'unmarked_inference' end as finding, query_id from search_hits where chunk_id is not null and hit_id is not null) select claim_id, finding, query_id from f qualify row_number() over (partition by claim_id, finding order by hit_id desc) = 1",
    "q_issues_resolved": f"""with {_H}, i as (select distinct query_id, chunk_id from h where right(chunk_id, 1) in ('1', '2')) select query_id as draft_id, count(*) filter (substring(chunk_id, length(chunk_id) - 2, 1) = '7' or substring(chunk_id, length(chunk_id) - 1, 1) = '9') = 0 as complete from i group by query_id""",
    "q_paper_card": f"""with {_H}, {_PAS}, fv as (select file_id, field, value, min(ev) as at_ from ps where value <> '' group by 1, 2, 3), l as (select file_id, field, string_agg(value, '|' order by at_) as vs, arg_min(value, at_) as v from fv group by 1, 2), w as (select distinct file_id from fv)
      select file_id, md5(max(v) filter (field = 'title')) as title, md5(max(v) filter (field = 'methodology')) as methodology, md5(coalesce(max(vs) filter (field = 'datasets'), '')) as datasets, md5(coalesce(max(vs) filter (field = 'metrics'), '')) as metrics, md5(coalesce(max(vs) filter (field = 'results'), '')) as results,
        concat_ws(',', case when count(*) filter (field = 'title') = 0 then 'title' end, case when count(*) filter (field = 'methodology') = 0 then 'methodology' end, case when count(*) filter (field = 'datasets') = 0 then 'datasets' end, case when count(*) filter (field = 'metrics') = 0 then 'metrics' end, case when count(*) filter (field = 'results') = 0 then 'results' end) as missing from w join l using (file_id) group by file_id""",
    "q_comparison_matrix": f"""with {_H}, {_PAS}, cells as (select file_id, dim from (select distinct file_id from ps) f, (select unnest(['title','methodology','datasets','metrics','results']) as dim) dd), g as (select file_id, field as dim, count(distinct nullif(value, '')) as vals, count(distinct ev) as evs, list_distinct(flatten(list({_NUM.format('value')}))) as vn, list_distinct(flatten(list({_NUM.format('quote')}))) as qn from ps group by 1, 2),
      m as (select cells.file_id, cells.dim, coalesce(vals, 0) as vals, coalesce(evs, 0) as evs, coalesce(len({_MINUS.format('vn', 'qn')}) = 0, true) as ok from cells left join g on g.file_id = cells.file_id and g.dim = cells.dim), w as (select dim, bool_and(evs > 0 and ok) filter (vals > 0) as con from m group by dim) select file_id, m.dim as dimension, vals as "values", evs as evidence, ok as verified, coalesce(con, false) as concluded from m join w using (dim)""",
    "q_quote_ground": f"""with {_H}, s as (select chunk_id, file_id, page_start, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as body, trim(regexp_replace(case when right(chunk_id, 1) = '9' then text else string_split(text, '. ')[1] end, '\\s+', ' ', 'g'), ' ') as quote from c where file_id is not null and text is not null and page_start is not null)
      select q.chunk_id as quote_id, min(p.page_start) as page from s q join s p on q.file_id = p.file_id where q.quote <> '' and p.body <> '' and ((contains(p.body, q.quote) and contains(' ' || p.body || ' ', ' ' || array_to_string(string_split(q.quote, ' ')[1:3], ' ') || ' ')) or (contains(q.quote, p.body) and contains(' ' || q.quote || ' ', ' ' || array_to_string(string_split(p.body, ' ')[1:3], ' ') || ' '))) group by q.chunk_id""",
    "q_evidence_map": f"with {_MAT} select doc_id, 'statement-' || pos as statement_id, ok as allowed_as_fact from em",
    "q_brief_gaps": f"with {_MAT} select brief_id, concat_ws(',', case when count(*) filter (doc_id % 4 = 0 and text is not null and trim(text, ' ') <> '') = 0 then 'user_points' end, case when not bool_or(ok) then 'supported_facts' end) as missing from em group by brief_id",
    "q_review_draft": """with r as (select trim(paper_id, ' ') || '/' || source as id, doc_id, doc_kind = 'review_note' as inf, substring(text, 1, 30) as t, doc_id % 4 as ns, doc_id % 3 as ne from documents where paper_id is not null and source is not null and text is not null), o as (select *, row_number() over (partition by id order by inf, doc_id) - 1 as i from r),
      l as (select *, case when inf then '推断：' || t else trim(t || ' ' || array_to_string(list_transform(range(1, ne + 1), lambda x: '[E' || x || ']'), ''), ' ') end as line, case when inf then null when ne = 0 then 'claim-' || i || ': fact has no evidence; claim-' || i || ': claim is not traceable' when ns = 0 then 'claim-' || i || ': claim is not traceable' end as err from o)
      select id as review_id, md5(string_agg(line, ' ' order by i)) as draft, coalesce(string_agg(err, '; ' order by i), '') as errors from l group by id""",
    "q_evidence_matrix": f"with {_H}, o as (select query_id, chunk_id, row_number() over (partition by query_id order by chunk_id) - 1 as place from (select distinct query_id, chunk_id from h) x) select query_id as theme, place, chunk_id as statement_id, file_id as source_id from o join c using (chunk_id) where page_start % 2 = 0",
}
