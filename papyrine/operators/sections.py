"""References to sections in requests: parsed, and resolved against a catalog of the files in scope.

A catalog is a table (file_id, section_id, number, title, ordinal); references come as (ref_id, file_id, ...), one row per file in
the scope of a request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.vectorized import title_similarity
from papyrine.plans.runtime import cut

# Names, patterns and confidences whose values decide results (fixed values).
ALIASES = {
    "abstract": ("abstract", "摘要"),
    "introduction": ("introduction", "intro", "引言", "绪论"),
    "related_work": ("related work", "literature review", "prior work", "相关工作", "文献综述"),
    "methods": ("methods", "method", "methodology", "materials and methods", "research methods", "方法", "研究方法", "材料与方法"),
    "dataset": ("dataset", "data set", "data", "数据集"),
    "model_architecture": ("model architecture", "model design", "模型架构", "模型结构"),
    "training_strategy": ("training strategy", "training procedure", "training", "训练策略", "训练过程"),
    "experiments": ("experiments", "experiment", "experimental evaluation", "实验"),
    "experimental_setup": ("experimental setup", "experiment setup", "evaluation setup", "实验设置"),
    "results": ("results", "result", "results and findings", "findings", "结果", "主要发现"),
    "discussion": ("discussion", "讨论"),
    "conclusion": ("conclusion", "conclusions", "结论"),
    "references": ("references", "bibliography", "参考文献"),
    "appendix": ("appendix", "supplement", "supplementary material", "附录", "补充材料"),
}
VALUE = r"(?:[A-Z]|[IVXLCDM]+|\d+)(?:\s*\.\s*\d+)*"
NUMBERED = (
    rf"(?i)第\s*({VALUE})\s*(?:章|节|部分)",
    rf"(?i)\b(?:section|sec(?:tion)?\.?|chapter)\s*({VALUE})\b",
    r"(?i)(?:\bappendix\b|附录)\s*([A-Z](?:\s*\.\s*\d+)*)",
    r"(?i)(?<![\p{L}\p{N}_.])(\d+(?:\s*\.\s*\d+)+|[A-Z]\s*\.\s*\d+)\s*(?:章|节|部分)",
)
BARE = r"(?<![\p{L}\p{N}_.])(\d+(?:\s*\.\s*\d+)+|[A-Z]\s*\.\s*\d+)\s+([A-Za-z][A-Za-z0-9 &'_/-]{1,79})"
TITLED = (r"(?i)([A-Za-z][A-Za-z0-9 &'_/-]{1,79}?)\s+(?:section|chapter)\b", r"([㐀-鿿A-Za-z][㐀-鿿A-Za-z0-9 ]{0,30}?)(?:部分|章节)")
PREVIOUS, CURRENT = r"(?:上一|前一)(?:节|章|部分|章节)", r"(?:这一|本|当前)(?:节|章|部分|章节)"
SUMMARY = ("总结", "概括", "概述", "主要讲", "summarize", "summary", "overview")
PREFIXES = (
    "请解释", "请总结", "给我讲一下", "解释", "总结", "概括", "概述", "介绍", "说明", "explain the ", "explain ", "summarize the ", "summarize ", "overview of the ", "overview of ", "what is in the ",
    "what does the ",
)
SYNONYMS = {"方法": "method methodology", "结果": "result results finding", "局限": "limitation limitation", "数据集": "dataset data"}
WIDE, NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))
THRESHOLD, MARGIN = 0.92, 0.06


def narrow(text: Column) -> Column:
    """Full-width letters, digits and marks as plain ones."""
    return F.translate(text, WIDE, NARROW)


def plain_number(value: Column) -> Column:
    """A section number without words, blanks and leading zeros, letters in capitals."""
    v = F.upper(F.trim(narrow(value)))
    v = F.regexp_replace(F.regexp_replace(v, r"^(?:SECTION|SEC(?:TION)?\.?|CHAPTER)\s*", ""), r"^第|\s*(?:章|节|部分)$", "")
    parts = F.filter(F.transform(F.split(v, r"\."), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(p)), ".")


def plain_title(value: Column) -> Column:
    t = F.lower(F.trim(narrow(value)))
    t = F.regexp_replace(t, rf"(?i)^(?:section|sec(?:tion)?\.?|chapter)\s+{VALUE}\s*", "")
    t = F.regexp_replace(t, r"^第\s*\d+(?:\s*\.\s*\d+)*\s*(?:章|节)\s*", "")
    t = F.regexp_replace(t, r"(?i)^(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z](?:\.\d+)*)\s+(?=\S)", "")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[_\-/]+", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}_㐀-鿿]+", " "))


def alias_of(title: Column) -> Column:
    """The canonical name that a plain title is one of the aliases of, or null."""
    return reduce(lambda c, kv: F.when(title.isin(*kv[1]), kv[0]).otherwise(c), reversed(ALIASES.items()), F.lit(None).cast("string"))


def _tidy(value: Column) -> Column:
    bare = F.regexp_replace(value, r"^[ ：:\-?？。！!,，;；]+|[ ：:\-?？。！!,，;；]+$", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\b(?:used|uses|say|says|describe|describes)\b.*$", ""))


def _without_prefix(text: Column) -> Column:
    t = F.trim(text)
    hit = reduce(lambda c, p: F.when(F.startswith(F.lower(t), F.lit(p)), F.trim(F.substr(t, F.lit(len(p) + 1)))).otherwise(c), reversed(PREFIXES), t)
    return hit


def parse(requests: DataFrame, text: str) -> DataFrame:
    """requests with kind, number, title, deictic, mode and confidence: previous or this section, a number, a bare number with a
    title, a named section, an alias that the request begins with, or none; the first that applies. What several rules look at
    is a column of its own, so that it is computed once."""
    t, request = F.col("_t"), F.col("_request")
    had = lambda c: F.col(c) != ""
    rows = requests.withColumn("_t", F.trim(narrow(F.col(text))))
    rows = rows.withColumns({"_low": F.lower(t), "_request": _without_prefix(t), **{f"_n{i}": F.regexp_extract(t, p, 1) for i, p in enumerate(NUMBERED)}})
    first = lambda f: reduce(lambda c, i: F.when(had(f"_n{i}"), f(i)).otherwise(c), reversed(range(len(NUMBERED))), F.lit(None).cast("string"))
    rest = first(lambda i: F.regexp_extract(t, "(?is)^.*?" + NUMBERED[i].removeprefix("(?i)") + "(.*)$", 2))
    rows = rows.withColumns({"_number": first(lambda i: F.col(f"_n{i}")), "_rest": rest, **{f"_x{i}": F.regexp_extract(request, p, 1) for i, p in enumerate(TITLED)}})
    named = reduce(lambda c, i: F.when(had(f"_x{i}"), _tidy(F.col(f"_x{i}"))).otherwise(c), reversed(range(len(TITLED))), F.lit(None).cast("string"))
    rows = rows.withColumns({"_said": named, "_whole": plain_title(t), "_asked": plain_title(request), "_rest": F.regexp_replace("_rest", r"^[ ：:\-]+|[ ：:\-]+$", "")})
    rows = rows.withColumn("_named", F.when(had("_said"), F.col("_said")))
    ordered = sorted((a for aliases in ALIASES.values() for a in aliases), key=len, reverse=True)
    known = F.array(*[F.lit(a) for a in ordered])
    rows = rows.withColumn("_longest", F.get(F.filter(known, lambda a: F.contains(F.col("_whole"), a)), F.lit(0)))
    alias = F.when(F.startswith(F.col("_asked"), F.col("_longest")), F.col("_longest"))
    after = F.when((F.col("_rest") != "") & ~F.col("_rest").rlike("^[的讲中里用]"), F.nullif(_tidy(F.split(F.col("_rest"), r"[?？。！!,，;；:：]")[0]), F.lit("")))
    rows = rows.withColumns({"_alias": alias, "_after": after, "_deictic": F.when(t.rlike(PREVIOUS), "previous").when(t.rlike(CURRENT), "current"), "_bare": t.rlike(BARE)})
    kind = F.when(F.col("_deictic").isNotNull(), "deictic").when(F.col("_number").isNotNull() | F.col("_bare"), "number").when(F.coalesce("_named", "_alias").isNotNull(), "title").otherwise("none")
    rows = rows.withColumn("kind", kind)
    is_ = lambda k: F.col("kind") == k
    plain = F.col("_number").isNotNull()
    summary = reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(w)) for w in SUMMARY])
    return rows.withColumns({
        "number": F.when(is_("number"), plain_number(F.when(plain, F.col("_number")).otherwise(F.regexp_extract(t, BARE, 1)))),
        "title": F.when(is_("number"), F.when(plain, F.col("_after")).otherwise(_tidy(F.regexp_extract(t, BARE, 2)))).when(is_("title"), F.coalesce("_named", "_alias")),
        "deictic": F.col("_deictic"), "mode": F.when(summary, "summary").otherwise("qa"),
        "confidence": F.when(is_("number") & ~plain, 0.99).when(is_("title"), F.when(F.col("_named").isNotNull(), 0.97).otherwise(0.93)).otherwise(1.0),
    }).drop("_t", "_low", "_number", "_rest", "_request", "_named", "_whole", "_asked", "_longest", "_alias", "_after", "_deictic", "_bare", "_said", *[f"_n{i}" for i in range(len(NUMBERED))], *[f"_x{i}" for i in range(len(TITLED))])


def rewritten(text: Column) -> Column:
    """The request, and after it once more with the translations of what it names, if it names any: its own terms then count
    twice."""
    t = F.trim(text)
    more = reduce(lambda c, kv: F.concat(c, F.when(F.contains(t, F.lit(kv[0])), F.lit(f" {kv[1]}")).otherwise("")), SYNONYMS.items(), F.lit(""))
    return F.when(more != "", F.concat(t, F.lit(" "), t, more)).otherwise(t)


def _picked(matches: DataFrame, kind: str, score: float) -> DataFrame:
    """(ref_id, status, section_id, match_kind, score, candidates): one match resolves, several are ambiguous."""
    s = matches.groupBy("ref_id").agg(F.count("*").alias("candidates"), F.min("section_id").alias("only"))
    one = F.col("candidates") == 1
    return s.select("ref_id", F.when(one, "resolved").otherwise("ambiguous").alias("status"), F.when(one, F.col("only")).alias("section_id"), F.lit(kind).alias("match_kind"), F.lit(score).alias("score"), "candidates")


def resolve(refs: DataFrame, catalog: DataFrame, threshold: float | None = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(ref_id, status, section_id, match_kind, score, candidates) of references (ref_id, file_id, kind, number, title, deictic,
    current_id, previous_id), one row per file in a reference's scope.

    A number is looked up exactly, a tie broken by an exact title, and never falls back to the title; a title exactly, then by
    alias, then by similarity, where those within `margin` of the best of the three nearest are ambiguous and one under
    `threshold` is none; a threshold of None leaves similarity out. Deictic references go by the section in context, and the
    one before it. Lookups join on equal keys; only similarity compares with each section of the files in scope.
    """
    known = cut(catalog.select("file_id", "section_id", "ordinal", plain_number(F.coalesce("number", F.lit(""))).alias("n"), plain_title(F.col("title")).alias("t")).withColumn("alias", alias_of(F.col("t"))))
    refs = cut(refs.withColumn("want", plain_title(F.coalesce("title", F.lit("")))))
    numbered = refs.where("kind = 'number'").join(known.where("n <> ''"), [refs.file_id == known.file_id, refs.number == known.n]).select("ref_id", "section_id", (F.col("want") == F.col("t")).alias("titled"))
    tie = numbered.groupBy("ref_id").agg(F.count("*").alias("all"), F.count_if("titled").alias("exact"))
    broken = tie.where("all > 1 and exact = 1").select("ref_id")
    by_number = _picked(numbered.join(broken, "ref_id", "left_anti"), "number_exact", 1.0).unionByName(_picked(numbered.where("titled").join(broken, "ref_id", "left_semi"), "number_title_exact", 1.0))
    titled = refs.where("kind = 'title'")
    exact = _picked(titled.join(known, [titled.file_id == known.file_id, titled.want == known.t]).select("ref_id", "section_id"), "title_exact", 1.0)
    left = titled.join(exact.select("ref_id"), "ref_id", "left_anti").withColumn("wanted", alias_of(F.col("want")))
    aliased = _picked(left.join(known, [left.file_id == known.file_id, left.wanted == known["alias"]]).select("ref_id", "section_id"), "alias_exact", 0.98)
    found = by_number.unionByName(exact).unionByName(aliased)
    if threshold is not None:
        rest = left.join(aliased.select("ref_id"), "ref_id", "left_anti").select("ref_id", F.col("file_id").alias("scope"), "want")
        scored = rest.join(known, rest.scope == known.file_id).select("ref_id", "section_id", "file_id", "ordinal", F.when((F.col("want") == "") | (F.col("t") == ""), 0.0).otherwise(title_similarity("want", "t")).alias("score"))
        order = Window.partitionBy("ref_id").orderBy(F.col("score").desc(), "file_id", "ordinal", "section_id")
        near = scored.withColumn("r", F.row_number().over(order)).where("r <= 3")
        best = near.groupBy("ref_id").agg(F.max("score").alias("top"), F.min_by("section_id", "r").alias("first"), F.collect_list("score").alias("scores")).where(F.col("top") >= threshold)
        close = F.size(F.filter("scores", lambda s: F.col("top") - s <= margin))
        found = found.unionByName(best.select("ref_id", F.when(close == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(close == 1, F.col("first")).alias("section_id"), F.lit("title_fuzzy").alias("match_kind"), F.col("top").alias("score"), close.cast("bigint").alias("candidates")))
    here = refs.where("kind = 'deictic' and current_id is not null").join(known.select(F.col("section_id").alias("current_id"), F.col("file_id").alias("in_file"), F.col("ordinal").alias("at")), "current_id")
    this = here.where("deictic = 'current'").select("ref_id", F.lit("resolved").alias("status"), F.col("current_id").alias("section_id"), F.lit("deictic_current").alias("match_kind"), F.lit(1.0).alias("score"), F.lit(1).cast("bigint").alias("candidates"))
    before = here.where("deictic = 'previous'").join(known.select(F.col("file_id").alias("in_file"), F.col("section_id").alias("earlier"), F.col("ordinal").alias("o")), "in_file").where("o < at").groupBy("ref_id", "previous_id").agg(F.max_by("earlier", "o").alias("earlier"))
    named = here.where("deictic = 'previous'").select("ref_id", "previous_id").join(known.select(F.col("section_id").alias("previous_id")), "previous_id", "left_semi")
    prior = before.select("ref_id", F.col("earlier").alias("section_id")).join(named, "ref_id", "left_anti").unionByName(named.select("ref_id", F.col("previous_id").alias("section_id")))
    found = found.unionByName(this.distinct()).unionByName(prior.distinct().select("ref_id", F.lit("resolved").alias("status"), "section_id", F.lit("deictic_previous").alias("match_kind"), F.lit(1.0).alias("score"), F.lit(1).cast("bigint").alias("candidates")))
    return refs.select("ref_id", "kind").distinct().join(found, "ref_id", "left").select("ref_id", F.coalesce("status", F.lit("unresolved")).alias("status"), "section_id", "match_kind", "score", F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"))


def resolver_metrics(outcomes: DataFrame) -> DataFrame:
    """(category, queries, right, rejected, ambiguous): shares per category of outcomes (category, expected, section_id, status)
    that are the expected section, unresolved and ambiguous."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    right = F.coalesce(F.col("section_id") == F.col("expected"), F.lit(False)) & (F.col("status") == "resolved")
    return outcomes.groupBy("category").agg(F.count("*").alias("queries"), share(right).alias("right"), share(F.col("status") == "unresolved").alias("rejected"), share(F.col("status") == "ambiguous").alias("ambiguous"))
