"""Queries over references to sections, and the same in SQL written on its own. A case's scope are the files whose number ends in the
same three digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import sections as S
from papyrine.plans.runtime import spread_rows
from papyrine.sources.tables import table


def catalog(spark, d):
    c = table(spark, d, "chunks").where("file_id is not null and size(section_path) > 0").groupBy("file_id", "section_path").agg(F.min("chunk_id").alias("ordinal"))
    last = F.try_element_at("section_path", F.lit(-1))
    return c.select("file_id", F.concat("file_id", F.lit("/"), F.array_join("section_path", "/")).alias("section_id"), F.nullif(F.regexp_extract(last, r"^(\d+(?:\.\d+)*)\s", 1), F.lit("")).alias("number"), last.alias("title"), "ordinal")


def _pairs(a, b, *rows):
    return F.array(*[F.struct(F.lit(x).alias(a), y.alias(b)) for x, y in rows])


def requests(spark, d):
    """Requests (ref_id, prompt): every case's own, and four made from its number."""
    r = spread_rows(table(spark, d, "eval_cases").where("prompt is not null").select("case_id", "prompt").distinct(), "case_id")
    n = F.length("prompt") % 9
    forms = F.array(*[F.lit(x) for x in ("请总结方法部分", "method", "Overview of the Results", "Explain the Related-Work section", "上一节讲了什么", "这一节", "reslts section", "Data")])
    made = _pairs(
        "v", "p", ("a", F.col("prompt")), ("b", F.concat(F.lit("Summarize section "), n.cast("string"), F.lit(".0"), (n % 4).cast("string"), F.lit(" Training used here?"))), ("c", F.element_at(forms, (n % 8 + 1).cast("int"))),
        ("d", F.concat(F.lit("请解释第 "), n.cast("string"), F.lit(" 节的内容"))), ("e", F.concat(F.lit("what does "), n.cast("string"), F.lit(".1 Error Analysis say?"))),
    )
    return r.select("case_id", F.explode(made).alias("m")).select(F.concat("case_id", F.lit(":"), F.col("m.v")).alias("ref_id"), "case_id", F.col("m.p").alias("prompt"))


def references(spark, d):
    parsed = S.parse(requests(spark, d), "prompt").withColumn("tail", F.substring("case_id", -3, 3))
    known = catalog(spark, d)
    files = known.select("file_id").distinct().select("file_id", F.substring("file_id", -3, 3).alias("tail"))
    first = known.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "section_id"))).alias("s"))
    place = lambda i: F.get("s", F.lit(i))["section_id"]
    scoped = parsed.join(files, "tail").join(first, "file_id")
    return scoped.select("ref_id", "file_id", "kind", "number", "title", "deictic", place(2).alias("current_id"), F.when(F.length("ref_id") % 2 == 0, place(0)).alias("previous_id"))


def q_section_parse(spark, d):
    return S.parse(requests(spark, d), "prompt").drop("case_id", "prompt")


def q_plain_titles(spark, d):
    c = table(spark, d, "chunks").where("size(section_path) > 0").select(F.explode("section_path").alias("title")).distinct()
    c = c.unionByName(c.select(F.concat(F.lit("Section 3.2 "), F.col("title")).alias("title"))).unionByName(c.select(F.concat(F.lit("Ｉ． "), F.replace("title", F.lit(" "), F.lit(" & "))).alias("title"))).distinct()
    return c.select("title", S.plain_title(F.col("title")).alias("plain"), S.alias_of(S.plain_title(F.col("title"))).alias("alias"))


def q_section_lookup(spark, d):
    """Section references by number, title, alias and context, without similarity."""
    return S.resolve(references(spark, d), catalog(spark, d), None)


def q_section_resolve(spark, d):
    """The same with similarity for titles that nothing else resolves."""
    r = S.resolve(references(spark, d), catalog(spark, d))
    return r.withColumn("score", F.round("score", 9))


def q_rewrite(spark, d):
    r = table(spark, d, "eval_cases").where("prompt is not null").select("case_id", "prompt").distinct()
    return r.select("case_id", F.md5(S.rewritten(F.col("prompt"))).alias("digest"), (F.length(S.rewritten(F.col("prompt"))) > 2 * F.length(F.trim("prompt"))).alias("expanded"))


def q_resolver_metrics(spark, d):
    """Every section asked for by its number and by its title within its file, and a number that no file has."""
    c = catalog(spark, d)
    plain = F.col("number").isNotNull() & F.col("title").rlike("^[A-Za-z0-9. -]+$") & ~F.contains("title", F.lit("Appendix"))
    ask = _pairs(
        "category", "q", ("number", F.concat(F.lit("Summarize section "), F.col("number"))), ("title", F.concat(F.lit("Explain the "), F.regexp_replace("title", r"^\d+(?:\.\d+)*\s+", ""), F.lit(" section"))), ("unresolved", F.lit("section 99.9")),
    )
    asked = c.where(plain).select("file_id", F.col("section_id").alias("expected"), F.explode(ask).alias("a")).select("file_id", "expected", "a.category", F.concat("expected", F.lit("|"), F.col("a.category")).alias("ref_id"), "a.q")
    refs = S.parse(asked, "q").select("ref_id", "file_id", "kind", "number", "title", "deictic", F.lit(None).cast("string").alias("current_id"), F.lit(None).cast("string").alias("previous_id"))
    outcome = S.resolve(refs, c, None).join(asked.select("ref_id", "category", F.when(F.col("category") != "unresolved", F.col("expected")).alias("expected")), "ref_id")
    return S.resolver_metrics(outcome).select("category", "queries", *[F.round(k, 9).alias(k) for k in ("right", "rejected", "ambiguous")])


QUERIES = {f.__name__: f for f in (q_section_parse, q_plain_titles, q_section_lookup, q_section_resolve, q_rewrite, q_resolver_metrics)}

_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_N = lambda x: f"translate({x}, '{_WIDE}', '{_NARROW}')"
_V = r"(?:[A-Z]|[IVXLCDM]+|\d+)(?:\s*\.\s*\d+)*"
_PL = lambda x: rf"trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({_N(x)}, ' ')), '(?i)^(?:section|sec(?:tion)?\.?|chapter)\s+{_V}\s*', ''), '^第\s*\d+(?:\s*\.\s*\d+)*\s*(?:章|节)\s*', ''), '(?i)^(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z](?:\.\d+)*)\s+(\S)', '\1'), '&', ' and '), '[_\-/]+', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\x{{3400}}-\x{{9fff}}]+', ' ', 'g'), ' ')"
_ALIAS_ROWS = ", ".join(f"('{a}', '{k}')" for k, v in S.ALIASES.items() for a in v)
_AL = f"aliases(name, canon) as (values {_ALIAS_ROWS})"
_NUMBERS = (rf"(?i)第\s*({_V})\s*(?:章|节|部分)", rf"(?i)\b(?:section|sec(?:tion)?\.?|chapter)\s*({_V})\b", r"(?i)(?:\bappendix\b|附录)\s*([A-Z](?:\s*\.\s*\d+)*)", r"(?i)(?:^|[^\p{L}\p{N}_.])(\d+(?:\s*\.\s*\d+)+|[A-Z]\s*\.\s*\d+)\s*(?:章|节|部分)")
_BAREN = r"(?:^|[^\p{L}\p{N}_.])(\d+(?:\s*\.\s*\d+)+|[A-Z]\s*\.\s*\d+)\s+([A-Za-z][A-Za-z0-9 &''_/-]{1,79})"
_TIDY = lambda x: rf"trim(regexp_replace(trim({x}, ' ：:-?？。！!,，;；'), '(?i)\b(?:used|uses|say|says|describe|describes)\b.*$', ''), ' ')"
_PRE = r"^(?:请解释|请总结|给我讲一下|解释|总结|概括|概述|介绍|说明|explain the |explain |summarize the |summarize |overview of the |overview of |what is in the |what does the )"
_T1, _T2 = r"(?i)([A-Za-z][A-Za-z0-9 &''_/-]{1,79}?)\s+(?:section|chapter)\b", r"([\x{3400}-\x{9fff}A-Za-z][\x{3400}-\x{9fff}A-Za-z0-9 ]{0,30}?)(?:部分|章节)"
_PNUM = lambda x: rf"array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(upper(trim({x}, ' ')), '^(?:SECTION|SEC(?:TION)?\.?|CHAPTER)\s*', ''), '.'), lambda p: trim(p, ' ')), lambda p: p <> ''), lambda p: case when regexp_full_match(p, '\d+') then cast(cast(p as int) as varchar) else p end), '.')"
_case = lambda f: "case " + " ".join(f"when regexp_matches(t, '{p}') then {f(p)}" for p in _NUMBERS) + " end"
_REQ = """r as (select distinct case_id, prompt, length(prompt) % 9 as n from eval_cases where prompt is not null),
reqs as (select case_id || ':' || m.v as ref_id, case_id, m.p as prompt from (select case_id, unnest([{'v': 'a', 'p': prompt}, {'v': 'b', 'p': 'Summarize section ' || n || '.0' || (n % 4) || ' Training used here?'},
  {'v': 'c', 'p': (['请总结方法部分', 'method', 'Overview of the Results', 'Explain the Related-Work section', '上一节讲了什么', '这一节', 'reslts section', 'Data'])[n % 8 + 1]}, {'v': 'd', 'p': '请解释第 ' || n || ' 节的内容'}, {'v': 'e', 'p': 'what does ' || n || '.1 Error Analysis say?'}]) as m from r) x)"""
_PARSE = rf"""{_AL}, p0 as (select ref_id, case_id, trim({_N("prompt")}, ' ') as t from reqs),
p1 as (select *, lower(t) as low, {_case(lambda p: f"regexp_extract(t, '{p}', 1)")} as num, {_case(lambda p: "regexp_extract(t, '(?is)^.*?" + p.removeprefix("(?i)") + "(.*)$', 2)")} as rest0, trim(regexp_replace(t, '(?i){_PRE}', ''), ' ') as req from p0),
p2 as (select *, trim(rest0, ' ：:-') as rest, case when regexp_matches(req, '{_T1}') then {_TIDY(f"regexp_extract(req, '{_T1}', 1)")} when regexp_matches(req, '{_T2}') then {_TIDY(f"regexp_extract(req, '{_T2}', 1)")} end as named, {_PL("t")} as whole, {_PL("req")} as asked from p1),
p3 as (select *, (select name from aliases where contains(whole, name) order by length(name) desc, name limit 1) as longest from p2),
parsed as (select ref_id, case_id, case when regexp_matches(t, '(上一|前一)(节|章|部分|章节)|(这一|本|当前)(节|章|部分|章节)') then 'deictic' when num is not null then 'number' when regexp_matches(t, '{_BAREN}') then 'number' when named <> '' then 'title' when starts_with(asked, longest) then 'title' else 'none' end as kind,
  regexp_matches(t, '(上一|前一)(节|章|部分|章节)') as prev, regexp_matches(t, '(这一|本|当前)(节|章|部分|章节)') as cur, num, t, rest, named, longest, asked, low from p3),
final as (select ref_id, case_id, kind, case when kind = 'number' then case when num is not null then {_PNUM("num")} else {_PNUM(f"regexp_extract(t, '{_BAREN}', 1)")} end end as number,
  case when kind = 'number' and num is not null then case when rest <> '' and not regexp_matches(rest, '^[的讲中里用]') then nullif({_TIDY("regexp_split_to_array(rest, '[?？。！!,，;；:：]')[1]")}, '') end when kind = 'number' then {_TIDY(f"regexp_extract(t, '{_BAREN}', 2)")} when kind = 'title' then case when named <> '' then named else longest end end as title,
  case when prev then 'previous' when cur then 'current' end as deictic, case when regexp_matches(low, '总结|概括|概述|主要讲|summarize|summary|overview') then 'summary' else 'qa' end as mode,
  cast(case kind when 'title' then case when named <> '' then 0.97 else 0.93 end when 'number' then case when num is not null then 1.0 else 0.99 end else 1.0 end as double) as confidence from parsed)"""
_CAT = rf"""cat0 as (select file_id, section_path, min(chunk_id) as ordinal from chunks where file_id is not null and len(section_path) > 0 group by file_id, section_path),
cat as (select file_id, file_id || '/' || array_to_string(section_path, '/') as section_id, nullif(regexp_extract(section_path[len(section_path)], '^(\d+(?:\.\d+)*)\s', 1), '') as number, section_path[len(section_path)] as title, ordinal from cat0)"""

SQL = {
    "q_section_parse": f"with {_REQ}, {_PARSE} select ref_id, kind, number, title, deictic, mode, confidence from final",
    "q_plain_titles": f"with {_AL}, c as (select distinct unnest(section_path) as title from chunks), u as (select title from c union select 'Section 3.2 ' || title from c union select 'Ｉ． ' || replace(title, ' ', ' & ') from c), p as (select title, {_PL('title')} as plain from u) select title, plain, canon as alias from p left join aliases on name = plain",
    "q_section_lookup": f"""with {_REQ}, {_PARSE}, {_CAT}, k as (select cat.*, {_PNUM("coalesce(number, '')")} as n, {_PL("title")} as t from cat), ka as (select k.*, canon from k left join aliases on name = t),
      f as (select distinct file_id, right(file_id, 3) as tail from cat), refs as (select ref_id, file_id, kind, number, {_PL("coalesce(title, '')")} as want, deictic from final join f on right(case_id, 3) = tail),
      nums as (select ref_id, section_id, want = t as titled from refs join ka on refs.file_id = ka.file_id and kind = 'number' and refs.number = n and n <> ''), nt as (select ref_id, count(*) as all_, count(*) filter (titled) as exact, min(section_id) as any_, min(section_id) filter (titled) as one from nums group by ref_id),
      ex as (select ref_id, count(*) as c, min(section_id) as one from refs join ka on refs.file_id = ka.file_id and kind = 'title' and want = t group by ref_id),
      al as (select ref_id, count(*) as c, min(section_id) as one from refs join aliases on name = want join ka on refs.file_id = ka.file_id and ka.canon = aliases.canon where kind = 'title' and ref_id not in (select ref_id from ex) group by ref_id),
      ranks as (select file_id, section_id, row_number() over (partition by file_id order by ordinal, section_id) as r, ordinal from cat),
      de as (select refs.ref_id, deictic, c.section_id as cur, case when length(refs.ref_id) % 2 = 0 then p0.section_id end as given, (select arg_max(x.section_id, x.ordinal) from cat x where x.file_id = c.file_id and x.ordinal < c.ordinal) as earlier
        from refs join ranks c on c.file_id = refs.file_id and c.r = 3 join ranks p0 on p0.file_id = refs.file_id and p0.r = 1 where kind = 'deictic'),
      hits as (select ref_id, case when all_ = 1 or exact = 1 then 'resolved' else 'ambiguous' end as status, case when all_ = 1 then any_ when exact = 1 then one end as section_id, case when all_ > 1 and exact = 1 then 'number_title_exact' else 'number_exact' end as match_kind, 1.0 as score, case when exact = 1 and all_ > 1 then 1 else all_ end as candidates from nt
        union all select ref_id, case when c = 1 then 'resolved' else 'ambiguous' end, case when c = 1 then one end, 'title_exact', 1.0, c from ex union all select ref_id, case when c = 1 then 'resolved' else 'ambiguous' end, case when c = 1 then one end, 'alias_exact', 0.98, c from al
        union all select ref_id, 'resolved', case when deictic = 'current' then cur else coalesce(given, earlier) end, 'deictic_' || deictic, 1.0, 1 from de where deictic = 'current' or coalesce(given, earlier) is not null)
      select r.ref_id, coalesce(status, 'unresolved') as status, section_id, match_kind, cast(score as double) as score, coalesce(candidates, 0) as candidates from (select distinct ref_id from refs) r left join (select distinct * from hits) h using (ref_id)""",
    "q_rewrite": """with r as (select distinct case_id, prompt, trim(prompt, ' ') as t from eval_cases where prompt is not null), m as (select *, case when contains(t, '方法') then ' method methodology' else '' end || case when contains(t, '结果') then ' result results finding' else '' end || case when contains(t, '局限') then ' limitation limitation' else '' end || case when contains(t, '数据集') then ' dataset data' else '' end as more from r)
      select case_id, md5(case when more <> '' then t || ' ' || t || more else t end) as digest, more <> '' as expanded from m""",
    "q_resolver_metrics": rf"""with {_AL}, {_CAT}, k as (select *, {_PL("title")} as t, count(*) over (partition by file_id, number) as same_n from cat), c as (select k.*, canon from k left join aliases on name = t), q as (select *, count(*) over (partition by file_id, t) as same_t from c where number is not null),
      w as (select c.file_id, c.section_id, c.same_n, (select count(*) from c x where x.file_id = c.file_id and x.t = c.t) as same_t from c where number is not null and regexp_full_match(title, '[A-Za-z0-9. -]+') and not contains(title, 'Appendix'))
      select 'number' as category, count(*) as queries, round(avg(case when same_n = 1 then 1.0 else 0.0 end), 9) as "right", 0.0::double as rejected, round(avg(case when same_n > 1 then 1.0 else 0.0 end), 9) as ambiguous from w
      union all select 'title', count(*), round(avg(case when same_t = 1 then 1.0 else 0.0 end), 9), 0.0, round(avg(case when same_t > 1 then 1.0 else 0.0 end), 9) from w union all select 'unresolved', count(*), 0.0, 1.0, 0.0 from w""",
}
