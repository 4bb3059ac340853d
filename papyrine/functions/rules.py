"""Rule-based text functions: terms, extraction, normal forms, guards, routers. Column builders inside Catalyst, but for three
batch functions where a text must be parsed as JSON or decomposed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.text import collapse

# Word lists and patterns whose values decide results (fixed values).
ANSWER_STOP = "the a an is are was were what which how does did of in to and 该 的 是 什么 如何".split()
REWRITE_STOP = "the a an is are and of to 这些 进行 结果".split()
TERM = r"[a-z0-9%]+|[一-鿿]{2,}"
WORD = r"[\p{L}\p{N}\p{M}_]+"
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:\.\d+)?%?"
FORMULA = r"\$[^$]+\$|\\\([^)]*\\\)|\\\[[^\]]*\\\]"
CITATION = r"\[[A-Za-z]?\d+(?:[-,]\s*[A-Za-z]?\d+)*\]"
INLINE_CITATION = r"\[([A-Za-z][\p{L}\p{N}_]*)\]"
SENSITIVE_KEYS = ("prompt", "response", "content", "paper_text", "api_key", "authorization", "secret", "password")
INJECTIONS = (
    r"(?i)ignore (?:all |the )?(?:previous|system) instructions?",
    r"(?i)reveal (?:the )?(?:system prompt|secret|api key)",
    r"(?i)(?:call|use|invoke) (?:the )?(?:tool|shell|terminal)",
    r"(?i)(?:delete|exfiltrate|upload|send) (?:all |the )?(?:files|data|paper)",
    r"(?i)你(?:现在)?(?:必须|应该).*(?:忽略|泄露|调用工具|删除)",
    r"(?i)忽略(?:之前|系统|所有).*(?:指令|规则|提示)",
    r"(?i)(?:system|developer)\s*:\s*",
)
BLOCKED = "[BLOCKED_UNTRUSTED_INSTRUCTION]"
ERROR_PREFIXES = (
    ("routing", ("route", "routing", "skill_")),
    ("planning", ("plan", "invalid_plan", "dependency", "budget_plan")),
    ("retrieval", ("rag", "retriev", "evidence_not_found")),
    ("tool_parameters", ("tool_invalid", "tool_argument", "schema_tool")),
    ("generation", ("generation", "unsupported_claim", "hallucination")),
    ("verification", ("verif", "citation_", "invariant_")),
    ("data", ("data", "invalid_gold", "dataset", "source_")),
    ("system", ("system", "timeout", "exception", "worker", "network")),
)
FIELD_PREFIXES = (
    ("title", ("title:", "题目：")),
    ("research_question", ("research question:", "研究问题：")),
    ("methodology", ("method:", "methodology:", "方法：")),
    ("datasets", ("dataset:", "datasets:", "数据集：")),
    ("metrics", ("metric:", "metrics:", "指标：")),
    ("results", ("result:", "results:", "结果：")),
    ("contributions", ("contribution:", "contributions:", "贡献：")),
    ("limitations", ("limitation:", "limitations:", "局限：")),
)
SIGNATURES = {
    "application/pdf": b"%PDF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": b"PK",
}
EXECUTABLE_NAMES = (".exe", ".dll", ".bat", ".cmd", ".ps1", ".sh")
ROUTES = {
    "follow_up": r"(?i)刚才|之前|前面|上面|上述|这个|那个|它|其|该|继续|接着|进一步|为什么|还有|再说|展开|详细一点|列举|举例|逐一|逐个|分别说明|具体有哪些|都有哪些|what about|continue|previous",
    "new_task": r"(?i)(?:帮我|请|现在).{0,12}(?:润色|改写|重写|总结|比较|检索|查找)|polish|rewrite|find papers|search papers",
    "long_memory": r"(?i)以前|历史|过去|之前的会话|其他会话|另一个会话|跨会话|曾经|上次聊|remember|previous conversation|earlier chat",
    "several": r"(?i)比较|对比|综述|综合|review|compare|synthesize",
    "named_source": r"(?i)crossref|semantic scholar|openalex|arxiv",
    "own_document": r"(?i)这篇论文|本文|已上传|上传的|附件|pdf 中|文档中",
    "discovery": r"(?i)(?:找|查找|搜索|检索|推荐).{0,48}(?:论文|文献|paper)|(?:论文|文献).{0,10}(?:推荐|搜索|检索)|\b(?:find|search|recommend)\b.{0,32}\bpapers?\b|\bpapers?\s+(?:about|on|related to)\b|literature search",
}
QUESTION_END = r"(?i)(?:呢|又如何|怎么样|如何|怎样|多少|哪些|是什么)[？?]?$"
QUERY_WRAPPERS = (
    r"^(?:请|请你)?(?:帮我|给我)?(?:查找|找|搜索|检索|推荐)(?:一下|一些|几篇)?(?:关于)?",
    r"(?i)^(?:please\s+)?(?:find|search(?:\s+for)?|recommend)\s+(?:some\s+)?papers?\s+(?:about|on)?\s*",
    r"(?:的)?(?:相关)?(?:论文|文献)[？?。.!]*$",
)
CONTINUES = r"(?i)继续|接着|刚才|之前|前面|上面|上述|那段|上一版|再润色|再改|continue|previous"
TASKS = (
    ("academic_rewrite", "academic_rewriter", 0.92, r"(?i)润色|改写|重写|优化表述|调整表达|语言优化|学术化|衔接|融入|polish|rewrite|paraphrase"),
    ("paper_discovery", "paper_discovery", 0.90, r"(?i)(?:检索|查找|搜索|推荐|寻找).{0,12}(?:论文|文献)|(?:论文|文献).{0,12}(?:检索|查找|搜索|推荐|寻找)|crossref|arxiv|openalex|semantic scholar"),
    ("paper_comparison", "comparison_analyzer", 0.75, r"(?i)比较|对比|异同|compare"),
    ("literature_synthesis", "literature_synthesizer", 0.75, r"(?i)综述|综合多篇|literature review"),
    ("document_summary", "summary_generator", 0.75, r"(?i)总结|摘要|概括|summar"),
    ("claim_analysis", "claim_verifier", 0.75, r"(?i)主张|论断|核验|引用|claim"),
)
DOCUMENT_WORDS = "论文|文章|章节|实验|方法|数据集"
GOALS = ("总结", "比较", "提取", "验证", "分析", "改写", "翻译")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})" if group == 0 else pattern), F.lit(1))


def memory_terms(text: Column) -> Column:
    """Words of any script in lower case, in order, with repeats."""
    return _all(F.lower(text), WORD)


def meaningful_terms(text: Column, stop: Sequence[str] = ANSWER_STOP) -> Column:
    """Latin words, figures and Han runs of two or more, in order, without stop words; repeats stay."""
    return F.filter(_all(F.lower(text), TERM), lambda t: ~t.isin(*stop))


def content_terms(text: Column) -> Column:
    return meaningful_terms(text, REWRITE_STOP)


def numbers(text: Column) -> Column:
    return _all(text, NUMBER)


def invariants(text: Column) -> Column:
    """A struct of what a rewrite must keep: distinct numbers, formulas and citations in the order they first stand."""
    return F.struct(*[F.array_distinct(_all(text, p)).alias(n) for n, p in (("numbers", NUMBER), ("formulas", FORMULA), ("citations", CITATION))])


def inline_citations(text: Column) -> Column:
    return _all(text, INLINE_CITATION, 1)


def doi(value: Column) -> Column:
    """A DOI in lower case without its resolver's address; null for what is none."""
    bare = F.trim(F.regexp_replace(value, r"(?i)^https?://(?:dx\.)?doi\.org/", ""))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(bare))


def title_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}\p{M}_]+", "")


def nullable_int(value: Column) -> Column:
    """A whole number, or null for blank and other text."""
    return F.try_to_number(F.when(F.trim(value).rlike(r"^[+-]?\d{1,18}$"), F.regexp_replace(F.trim(value), r"^\+", "")), F.lit("S999999999999999999")).cast("bigint")


def first_part(*dates: Column) -> Column:
    """The first part of the first date that has parts."""
    return F.coalesce(*[F.when(F.size(d) > 0, F.get(d, F.lit(0))) for d in dates])


def case_seed(seed: int, key: Column) -> Column:
    """The first eight bytes of a hash of seed and key, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("bigint")


def injection_guard(text: Column) -> Column:
    """(matches, risk, allowed, cleaned) of a text from outside: patterns in order, each match in the order it stands."""
    found = F.concat(*[_all(text, p) for p in INJECTIONS])
    cleaned = reduce(lambda t, p: F.regexp_replace(t, p, F.lit(BLOCKED.replace("[", "\\["))), INJECTIONS, text)
    return F.struct(found.alias("matches"), F.least(F.lit(1.0), F.size(found) / F.lit(2.0)).alias("risk"), (F.size(found) == 0).alias("allowed"), cleaned.alias("cleaned"))


def _starts(text: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def error_category(code: Column) -> Column:
    """The first category one of whose prefixes the code has; the order decides; unknown and missing codes are system."""
    low = F.lower(F.trim(code))
    chain = reduce(lambda c, p: F.when(_starts(low, p[1]), p[0]) if c is None else c.when(_starts(low, p[1]), p[0]), ERROR_PREFIXES, None)
    return chain.otherwise("system")


def field_of(text: Column) -> Column:
    low = F.lower(F.trim(text))
    chain = reduce(lambda c, p: F.when(_starts(low, p[1]), p[0]) if c is None else c.when(_starts(low, p[1]), p[0]), FIELD_PREFIXES, None)
    return chain


def field_value(text: Column) -> Column:
    """A passage without the prefix that names its field."""
    prefixes = "|".join(p for _, ps in FIELD_PREFIXES for p in ps)
    return F.trim(F.regexp_replace(F.trim(text), f"(?i)^(?:{prefixes})", ""))


def routes(text: Column) -> dict[str, Column]:
    """Which way a request goes: follow_up, new_task, long_memory, several (papers), discovery (of papers elsewhere)."""
    flag = {name: text.rlike(p) for name, p in ROUTES.items()}
    bare = F.regexp_replace(text, r"\s+", "")
    return {
        "follow_up": flag["follow_up"] | ((F.length(bare) <= 40) & bare.rlike(QUESTION_END)),
        "new_task": (F.length(F.trim(text)) >= 100) | flag["new_task"],
        "long_memory": flag["long_memory"],
        "several": flag["several"],
        "discovery": flag["named_source"] | (flag["discovery"] & ~flag["own_document"]),
    }


def bare_query(text: Column) -> Column:
    """A search request without its wrapper; the request itself where under two characters are left."""
    query = collapse(text)
    for p in QUERY_WRAPPERS:
        query = F.regexp_replace(query, p, "")
    return F.when(F.length(F.trim(query)) >= 2, F.trim(query)).otherwise(F.trim(text))


def safe_name(value: Column) -> Column:
    return value.rlike(r"^[\p{L}\p{N}\-_.]+$")


def safe_key(value: Column, buckets: Sequence[str]) -> Column:
    """Whether an object key is relative, doesn't climb and begins with one of the buckets."""
    parts = F.filter(F.split(value, "/"), lambda p: (p != "") & (p != "."))
    return ~F.startswith(value, F.lit("/")) & ~F.array_contains(parts, "..") & (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(*buckets)


def file_problem(name: Column, mime: Column, data: Column) -> Column:
    """The first reason against an uploaded file, or null: an executable's name or signature, a type that its first bytes don't
    have, active content."""
    start = lambda b: F.substring(data, 1, len(b)) == F.lit(bytearray(b))
    chain = F.when(F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in EXECUTABLE_NAMES) + ")$"), "executable_name").when(start(b"MZ") | start(b"\x7fELF"), "executable_signature")
    for kind, signature in SIGNATURES.items():
        chain = chain.when((mime == kind) & ~start(signature), "signature_mismatch")
    raw = F.hex(data)
    active = reduce(lambda a, b: a | b, [F.contains(raw, F.lit(w.encode().hex().upper())) for w in ("/JavaScript", "/Launch")])
    return chain.when(F.startswith(mime, F.lit("text/")) & ~F.is_valid_utf8(data.cast("string")), "not_utf8").when(active, "active_content")


def ratio_or_null(a: Column, b: Column) -> Column:
    """Metrics: nothing to divide by is no value."""
    return F.try_divide(a.cast("double"), b)


def ratio_or_one(a: Column, b: Column) -> Column:
    """Completion: nothing was asked for, so all of it is there."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0))


def ratio_at_least(a: Column, b: Column) -> Column:
    """Retrieval: nothing counts as one."""
    return a / F.greatest(b, F.lit(1))


def padded(vector: Column, size: int) -> Column:
    """A vector with zeros behind it, or cut, to this many numbers."""
    return F.slice(F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


def requirement(text: Column, files: Column, inline: Column, material: Column, pending: Column) -> Column:
    """(task, relation, source, memory, skill, confidence, missing) of a request, by the first rule that applies."""
    t = F.trim(text)
    relation = F.when(pending & (F.length(t) < 80), "answer_clarification").when(t.rlike(CONTINUES), "continue_previous").otherwise("new_task")
    rewrite = t.rlike(TASKS[0][3])
    chain, skill, sure = F.lit(None).cast("string"), F.lit("paper_reader"), F.lit(0.75)
    chain = F.when((files > 0) | t.rlike(DOCUMENT_WORDS), "document_qa").otherwise("general_answer")
    for name, tool, confidence, pattern in reversed(TASKS):
        hit = t.rlike(pattern)
        chain, skill, sure = F.when(hit, name).otherwise(chain), F.when(hit, tool).otherwise(skill), F.when(hit, confidence).otherwise(sure)
    uploaded = F.when(files > 0, "uploaded_files")
    source = F.when(rewrite, F.when(inline, "inline_text").otherwise(F.coalesce(uploaded, F.when(material, "conversation_material").otherwise("none"))))
    source = F.coalesce(source, F.when(chain == "paper_discovery", "external"), uploaded, F.lit("none"))
    memory = F.when(rewrite, F.when(source == "conversation_material", "specific_material").otherwise("none")).when((chain != "paper_discovery") & (relation != "new_task"), "recent_context").otherwise("none")
    missing = F.when(rewrite & (source == "none"), F.array(F.lit("source_text"))).otherwise(F.array().cast("array<string>"))
    return F.struct(chain.alias("task"), relation.alias("relation"), source.alias("source"), memory.alias("memory"), skill.alias("skill"), sure.alias("confidence"), missing.alias("missing"))


def constraints(text: Column) -> Column:
    """(sources, language, focus, missing) of a request."""
    sources = F.array_distinct(_all(text, r"(?i:[\p{L}\p{N}_.\-]+\.pdf)"))
    has = lambda w: F.contains(text, F.lit(w))
    focus = F.when(has("方法和实验"), "方法和实验").when(has("方法"), "方法").when(has("实验"), "实验")
    goal = reduce(lambda a, b: a | b, [has(g) for g in GOALS])
    missing = F.array_compact(F.array(F.when(~goal, "goal"), F.when(F.size(sources) == 0, "source"), F.when(has("比较") & (F.size(sources) < 2), "comparison_sources")))
    return F.struct(sources.alias("sources"), F.when(has("中文"), "zh").alias("language"), focus.alias("focus"), missing.alias("missing"))


def input_problem(files: Column, least: Column, most: Column, needs_source: Column, available: Mapping[str, Column], accepted: Column) -> Column:
    """The first reason why a task can't begin, or null: too few or too many files, or none of the accepted sources at hand."""
    at_hand = F.array_compact(F.array(*[F.when(c, name) for name, c in available.items()]))
    return F.when(files < least, "uploaded_files").when(files > most, "too_many_files").when(needs_source & ~F.arrays_overlap(at_hand, accepted), "source_material")


def eligible(name: Column, tools: Column, most_files: Column, barred: Column, request: Column, permitted: Column, permitted_tools: Column, files: Column) -> Column:
    """Whether a skill may be offered: it and all its tools permitted, no more files than it takes, no barring phrase in the
    request. A null permission permits all, a null number of files or limit bars none."""
    allowed = F.coalesce(F.array_contains(permitted, name), F.lit(True))
    with_tools = F.coalesce(F.size(F.array_except(tools, permitted_tools)) == 0, F.lit(True))
    few = F.coalesce(files <= most_files, F.lit(True))
    return allowed & with_tools & few & ~F.exists(barred, lambda b: F.contains(F.lower(request), F.lower(b)))


def _redacted(value: object, keys: frozenset[str], key: str = "") -> object:
    if key.casefold() in keys:
        shown = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        return {"redacted": True, "sha256": hashlib.sha256(shown.encode()).hexdigest(), "length": len(shown)}
    if isinstance(value, dict):
        return {k: _redacted(v, keys, k) for k, v in value.items()}
    return [_redacted(v, keys) for v in value] if isinstance(value, list) else value


def redact_json(keys: Sequence[str] = SENSITIVE_KEYS):
    """A batch function over JSON text: at any depth, the value of a sensitive key becomes its hash and length. Broken JSON is
    redacted as a whole; null stays null."""
    wanted = frozenset(k.casefold() for k in keys)

    @F.pandas_udf(T.StringType())
    def redact(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return json.dumps(_redacted(json.loads(t), wanted), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return json.dumps(_redacted(t, wanted, next(iter(wanted))), sort_keys=True)

        return text.map(one)

    return redact


@F.pandas_udf(T.StringType())
def canonical_sha256(text: pd.Series) -> pd.Series:
    """The SHA-256 of JSON text with sorted keys and no white space, so that equal objects have equal hashes; null for null and
    broken JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else hashlib.sha256(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except ValueError:
            return None

    return text.map(one)


def contract_problems(schema: Mapping):
    """A batch function: where JSON text breaks a contract (type, enum, required, additionalProperties, properties, items), as
    paths with what is wrong there, in document order. Null and broken JSON break it at the root."""
    kinds = {"object": (dict,), "array": (list,), "string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "null": (type(None),)}

    def walk(value: object, rule: Mapping, path: str) -> list[str]:
        named = rule.get("type")
        named = named if isinstance(named, list) else [named] if named else []
        wanted = [k for n in named for k in kinds.get(n, ())]
        if wanted and (not isinstance(value, tuple(wanted)) or (isinstance(value, bool) and bool not in wanted)):
            return [f"{path}: type"]
        found = [f"{path}: enum"] if "enum" in rule and value not in rule["enum"] else []
        if isinstance(value, dict):
            known = rule.get("properties", {})
            found += [f"{path}.{k}: missing" for k in rule.get("required", []) if k not in value]
            if rule.get("additionalProperties") is False:
                found += [f"{path}.{k}: unexpected" for k in value if k not in known]
            for k, inner in known.items():
                if k in value:
                    found += walk(value[k], inner, f"{path}.{k}")
        if isinstance(value, list) and "items" in rule:
            for i, item in enumerate(value):
                found += walk(item, rule["items"], f"{path}[{i}]")
        return found

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return ["$: missing"] if t is None else walk(json.loads(t), schema, "$")
            except ValueError:
                return ["$: broken"]

        return text.map(one)

    return check
