"""Checks of answers against evidence: outputs, claims, completion, rewrites, drafts, judgements, comparison and review."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from papyrine.functions import rules as X
from papyrine.functions.text import collapse

SUPPORTED, GROUNDED, SEMANTIC = 0.8, 0.5, 4.5
#: Letters of one document's pages, and of its quotes, that one task takes; quotes are held in memory, pages stream past them.
BODY_SHARE, QUOTE_SHARE = 64_000_000, 16_000_000


def _some(array: Column) -> Column:
    return F.size(array) > 0


def verify_output(text: Column, present: Column, required: Column, bare_severe: Column, source: Column, citations: Column, terms: Column, repairs: Column, most: int = 2) -> Column:
    """(status, issues, coverage): passed without issues, failed once as many repairs were made, else needs_repair. Issues are
    missing fields, severe claims without evidence, numbers that the source lacks, unknown citations, terms that are gone."""
    missing = F.array_except(required, present)
    strange = F.array_except(X.numbers(text), X.numbers(source))
    unknown = F.array_except(X.inline_citations(text), citations)
    gone = F.filter(terms, lambda t: ~F.contains(text, t))
    issues = F.array_compact(F.array(F.when(_some(missing), "schema_missing"), F.when(bare_severe > 0, "unsupported_severe_claim"), F.when((source != "") & _some(strange), "number_mismatch"), F.when(_some(unknown), "invalid_citation"), F.when(_some(gone), "invariant_missing")))
    status = F.when(F.size(issues) == 0, "passed").when(repairs >= most, "failed").otherwise("needs_repair")
    coverage = X.ratio_or_one(F.size(F.array_intersect(required, present)), F.size(F.array_distinct(required)))
    return F.struct(status.alias("status"), issues.alias("issues"), coverage.alias("coverage"))


def support(claim: Column, evidence: Column) -> Column:
    """(share, supported): the share of the claim's meaningful terms that the evidence holds; a claim without any has none."""
    c, e = F.array_distinct(X.meaningful_terms(claim)), X.meaningful_terms(evidence)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(c, e)), F.size(c)), F.lit(0.0))
    return F.struct(share.alias("share"), (share >= SUPPORTED).alias("supported"))


def rewrite_check(original: Column, rewritten: Column, terms: Column) -> Column:
    """(missing, preserved, semantic, passed): what a rewrite must keep and lacks, the share it keeps, and how much of the
    original's content it still says, out of five."""
    kept = X.invariants(original)
    required = F.concat(kept["numbers"], kept["formulas"], kept["citations"], F.array_distinct(terms))
    missing = F.filter(required, lambda r: ~F.contains(rewritten, r))
    before, after = F.array_distinct(X.content_terms(original)), X.content_terms(rewritten)
    semantic = F.least(F.lit(5.0), X.ratio_at_least(F.size(F.array_intersect(before, after)), F.size(before)) * 5)
    preserved = X.ratio_at_least(F.size(required) - F.size(missing), F.size(required))
    return F.struct(missing.alias("missing"), preserved.alias("preserved"), semantic.alias("semantic"), ((F.size(missing) == 0) & (semantic >= SEMANTIC)).alias("passed"))


def traceability(draft: DataFrame, matrix: DataFrame) -> DataFrame:
    """(draft_id, claim_id, finding) of draft claims (draft_id, claim_id, inferred, refs): those that the matrix (claim_id, refs)
    lacks and that aren't marked as inferred, and those that cite more than their row there."""
    known = matrix.select("claim_id", F.col("refs").alias("known"))
    rows = draft.join(known, "claim_id", "left")
    finding = F.when(F.col("known").isNull() & ~F.col("inferred"), "unmarked_inference").when(F.size(F.array_except("refs", "known")) > 0, "citation_mismatch")
    return rows.select("draft_id", "claim_id", finding.alias("finding")).where("finding is not null")


def severe_rate(answers: DataFrame) -> DataFrame:
    """(answer_id, rate) of answers (answer_id, citations, claims, valid): the share of claims (evidence, inferred) without valid
    evidence that aren't inferred; without claims 0 if there are citations and 1 if not."""
    bare = F.filter("claims", lambda c: ~F.arrays_overlap(c["evidence"], F.col("valid")) & ~c["inferred"])
    rate = F.when(F.size("claims") == 0, F.when(F.col("citations") > 0, 0.0).otherwise(1.0)).otherwise(F.size(bare) / F.size("claims"))
    return answers.select("answer_id", rate.alias("rate"))


def completion(cases: DataFrame, claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame, evidence_claims: DataFrame, targets: DataFrame, numerics: DataFrame) -> DataFrame:
    """(case_id, decision, missing_count, schema_coverage, claim_evidence_coverage, valid_evidence_rate, target_paper_coverage,
    numeric_verification_rate, evidence_map_coverage, issues): whether each case is done.

    cases (case_id, empty, required, present, mapped, kind, minimum, quality, least_quality, text, terms, review, pending,
    tool_ok, ask, fatal, repairs, most_repairs, replan); claims (case_id, claim_id, factual); claim_evidence (case_id, claim_id,
    evidence_id); evidence (case_id, evidence_id, source_id, page, trusted); evidence_claims (case_id, evidence_id, claim_id);
    targets (case_id, paper_id); numerics (case_id, claim_id, evidence_id, verified). Nothing is gathered but each case's
    distinct issues; evidence counts if it is trusted, has a source and a page, and a link counts if both sides name it.
    """
    key = ["case_id"]
    issue = lambda df, text: df.select("case_id", text.alias("issue"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) if isinstance(p, str) else p for p in parts])
    sound_source, sound_page = F.trim(F.coalesce("source_id", F.lit(""))) != "", F.coalesce(F.col("page") >= 1, F.lit(False))
    seen = evidence.withColumn("valid", sound_source & sound_page & F.col("trusted"))
    good = seen.where("valid").select("case_id", "evidence_id", "source_id")
    links = claims.where("factual").join(claim_evidence, ["case_id", "claim_id"])
    found = links.join(good.select("case_id", "evidence_id", F.lit(True).alias("ok")), ["case_id", "evidence_id"], "left").join(evidence_claims.withColumn("linked", F.lit(True)), ["case_id", "evidence_id", "claim_id"], "left")
    found = found.withColumn("sound", F.coalesce(F.col("ok") & F.col("linked"), F.lit(False)))
    state = claims.where("factual").join(found.groupBy("case_id", "claim_id").agg(F.max("sound").alias("covered")), ["case_id", "claim_id"], "left")
    weak = found.join(state.where("not covered").select("case_id", "claim_id"), ["case_id", "claim_id"])
    used = found.where("sound").select("case_id", "evidence_id").distinct()
    covered = good.select("case_id", F.col("source_id").alias("paper_id")).distinct()
    flags = cases.select("*", F.lower("kind").alias("k"))
    compares, writes = F.col("k").rlike("compar|aggregate"), F.col("k").rlike("writ|draft")
    absent = targets.distinct().join(covered, ["case_id", "paper_id"], "left_anti").join(flags.where(compares).select("case_id"), key)
    unmapped = claims.where("factual").join(flags.where(writes).select("case_id", "mapped"), key).where(~F.array_contains("mapped", F.col("claim_id")))
    enough = flags.where("minimum > 0").join(good.groupBy("case_id").agg(F.count("*").alias("all_good")), key, "left").join(used.groupBy("case_id").agg(F.count("*").alias("in_use")), key, "left")
    number = numerics.join(good.select("case_id", "evidence_id", F.lit(True).alias("ok")), ["case_id", "evidence_id"], "left")
    parts = [
        issue(flags.where("empty"), F.lit("output:non_empty")),
        issue(flags.select("case_id", F.explode(F.array_except("required", "present")).alias("f")), say("field:", "$f")),
        issue(seen.where(~sound_source), say("evidence:", "$evidence_id", ":source")), issue(seen.where(~sound_page), say("evidence:", "$evidence_id", ":page")), issue(seen.where("not trusted"), say("evidence:", "$evidence_id", ":untrusted")),
        issue(state.where("covered is null"), say("claim:", "$claim_id", ":missing_evidence")),
        issue(weak.where("ok is null"), say("claim:", "$claim_id", ":invalid_evidence:", "$evidence_id")), issue(weak.where("ok and linked is null"), say("claim:", "$claim_id", ":unlinked_evidence:", "$evidence_id")),
        issue(enough.where(F.coalesce("in_use", "all_good", F.lit(0)) < F.col("minimum")), say("evidence:minimum:", F.col("minimum").cast("string"))),
        issue(absent, say("paper:", "$paper_id")),
        issue(number.where("not verified"), say("numeric_claim:", "$claim_id")), issue(number.where("verified and evidence_id is not null and ok is null"), say("numeric_claim:", "$claim_id", ":invalid_evidence")),
        issue(unmapped, say("evidence_map:", "$claim_id")),
        issue(flags.where(writes).select("case_id", F.explode(F.filter("terms", lambda t: ~F.contains(F.col("text"), t))).alias("t")), say("immutable_term:", "$t")),
        issue(flags.where(writes & F.col("review") & ~F.col("pending")), F.lit("pending_review")),
        issue(flags.where("least_quality is not null and (quality is null or quality < least_quality)"), F.lit("quality:minimum")),
        issue(flags.where("ask"), F.lit("user_input:required")), issue(flags.where("fatal is not null"), say("fatal:", "$fatal")), issue(flags.where("not tool_ok"), F.lit("tool:failed")),
    ]
    problems = reduce(DataFrame.unionByName, parts).distinct().groupBy("case_id").agg(F.count("*").alias("missing_count"), F.array_sort(F.collect_list("issue")).alias("issues"))
    per_claim = state.groupBy("case_id").agg(F.count("*").alias("claims"), F.count_if("covered").alias("covered"))
    per_map = claims.where("factual").join(cases.select("case_id", "mapped"), key).groupBy("case_id").agg(F.count_if(F.array_contains("mapped", F.col("claim_id"))).alias("in_map"))
    per_evidence = seen.groupBy("case_id").agg(F.count("*").alias("evidence"), F.count_if("valid").alias("good"))
    per_target = targets.distinct().join(covered.withColumn("hit", F.lit(True)), ["case_id", "paper_id"], "left").groupBy("case_id").agg(F.count("*").alias("targets"), F.count_if("hit").alias("hits"))
    per_number = numerics.groupBy("case_id").agg(F.count("*").alias("numbers"), F.count_if("verified").alias("verified"))
    all_ = reduce(lambda a, b: a.join(b, key, "left"), (problems, per_claim, per_map, per_evidence, per_target, per_number), cases)
    z = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda a, b: X.ratio_or_one(z(a), F.nullif(z(b), F.lit(0)))
    stuck = F.when(F.col("replan"), "replan").otherwise("fail")
    decision = F.when(F.col("fatal").isNotNull(), "fail").when(F.col("ask"), "ask_user").when(~F.col("tool_ok"), stuck).when(z("missing_count") == 0, "complete").when(F.col("repairs") < F.col("most_repairs"), "repair").otherwise(stuck)
    return all_.select(
        "case_id", decision.alias("decision"), z("missing_count").alias("missing_count"), X.ratio_or_one(F.size(F.array_intersect("required", "present")), F.nullif(F.size("required"), F.lit(0))).alias("schema_coverage"), ratio("covered", "claims").alias("claim_evidence_coverage"),
        ratio("good", "evidence").alias("valid_evidence_rate"), ratio("hits", "targets").alias("target_paper_coverage"), ratio("verified", "numbers").alias("numeric_verification_rate"), ratio("in_map", "claims").alias("evidence_map_coverage"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
    )


def case_score(answer: Column, reference: Column, level: Column, f1: Column, gold: Column, cited: Column, needs_evidence: Column) -> Column:
    """(correctness, recall, success): yes and no by how the answer begins, first-level cases by whether it holds the reference,
    others by the F1 of terms; success also needs a cited gold place where evidence is needed."""
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[.。]+$", "")
    a, r = tidy(answer), tidy(reference)
    closed, simple = r.isin("yes", "no"), level == "L1"
    right = F.when(closed, F.startswith(a, r).cast("int").cast("double")).when(simple, F.contains(a, r).cast("int").cast("double")).otherwise(f1)
    recall = X.ratio_or_one(F.size(F.array_intersect(gold, cited)), F.nullif(F.size(F.array_distinct(gold)), F.lit(0)))
    success = (right >= F.when(closed | simple, 1.0).otherwise(0.5)) & (~needs_evidence | (recall > 0))
    return F.struct(right.alias("correctness"), recall.alias("recall"), success.alias("success"))


def failure_category(family: Column, success: Column, correctness: Column, recall: Column, retrieved: Column, has_papers: Column, needs_evidence: Column) -> Column:
    """Why a case failed, by the first rule that applies; null for a success."""
    chain = F.when(success, None).when((retrieved == 0) & has_papers, "retrieval")
    for kind, families in (("routing", ("skill_tool_category", "skill_tool_discipline", "robustness_clarification")), ("tool_parameters", ("robustness_tool_failure",)), ("planning", ("robustness_partial_failure", "robustness_cancellation")), ("verification", ("robustness_prompt_injection", "robustness_citation_ambiguity"))):
        chain = chain.when(family.isin(*families), kind)
    return chain.when(needs_evidence & (recall == 0), "verification").when(correctness < 0.5, "generation").otherwise("routing")


def judge(cited: Column, gold: Column, needs_evidence: Column, answer: Column, reference: Column) -> Column:
    """fail for evidence outside the gold set or none where it is needed, pass for the reference answer, fail for another than a
    yes or no, else abstain."""
    same = lambda c: F.lower(collapse(c))
    return F.when(F.size(F.array_except(cited, gold)) > 0, "fail").when(needs_evidence & (F.size(cited) == 0), "fail").when(same(answer) == same(reference), "pass").when(same(reference).isin("yes", "no", "yes.", "no."), "fail").otherwise("abstain")


def draft_problem(answer: Column, evidence: Column, assigned: Column, missing: Column, issues: Column, resolved: Column) -> Column:
    """The first rule that a draft breaks, or null: citations in the text, all of them known, every readable paper cited, every
    unreadable one named, every issue resolved. evidence is an array of (citation, paper)."""
    inline = F.array_distinct(F.transform(X.inline_citations(answer), lambda c: F.upper(c)))
    known = F.transform(evidence, lambda e: F.upper(e["citation"]))
    covered = F.transform(F.filter(evidence, lambda e: F.array_contains(inline, F.upper(e["citation"]))), lambda e: e["paper"])
    hidden = F.filter(missing, lambda p: ~F.contains(answer, p))
    apart = F.concat(F.array_except(issues, resolved), F.array_except(resolved, issues))
    return (
        F.when(F.size(inline) == 0, "missing_inline_citations").when(_some(F.array_except(inline, known)), "unknown_inline_citations").when(_some(F.array_except(F.array_except(assigned, missing), covered)), "readable_paper_not_cited")
        .when(_some(hidden), "missing_paper_not_disclosed").when(_some(apart), "critic_issues_not_resolved")
    )


def merge_findings(findings: DataFrame, order: str) -> DataFrame:
    """One finding per claim and kind; a later source takes the place of an earlier one."""
    rest = [c for c in findings.columns if c not in ("claim_id", "finding", order)]
    return findings.groupBy("claim_id", "finding").agg(*[F.max_by(c, order).alias(c) for c in rest])


def issues_resolved(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(draft_id, complete): whether the resolutions (draft_id, issue_id, status) name exactly the issues (draft_id, issue_id) and
    none is open."""
    a = issues.select("draft_id", "issue_id", F.lit(True).alias("raised")).distinct()
    b = resolutions.groupBy("draft_id", "issue_id").agg(F.max(F.col("status") == "open").alias("open"))
    both = a.join(b, ["draft_id", "issue_id"], "full")
    return both.groupBy("draft_id").agg(F.bool_and(F.coalesce(F.col("raised") & ~F.col("open"), F.lit(False))).alias("complete"))


def cards(passages: DataFrame, once: Sequence[str], many: Sequence[str]) -> DataFrame:
    """(file_id, fields...) from passages (file_id, evidence_id, field, value): the first value of fields that have one, the
    distinct values, in the order they first stand, of the others, and the fields without any."""
    first = passages.where("value <> ''").groupBy("file_id", "field", "value").agg(F.min("evidence_id").alias("at"))
    single = [F.min_by("value", F.when(F.col("field") == f, F.col("at"))).alias(f) for f in once]
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "value")))), lambda x: x["value"]).alias(f) for f in many]
    rows = first.groupBy("file_id").agg(*single, *listed)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in once], *[F.when(F.size(f) == 0, f) for f in many]))
    return rows.withColumn("missing", missing)


def comparison(passages: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(file_id, dimension, values, evidence, verified, concluded) of every file and dimension, from passages (file_id, evidence_id,
    field, value, quote): how many values and pieces of evidence there are, whether the values' numbers stand in the quotes,
    and whether the dimension can be concluded: every cell with values has evidence and verified numbers."""
    cells = passages.select("file_id").distinct().select("file_id", F.explode(F.array(*[F.lit(x) for x in dimensions])).alias("dimension"))
    have = passages.where(F.col("field").isin(*dimensions)).groupBy("file_id", F.col("field").alias("dimension")).agg(F.countDistinct(F.nullif("value", F.lit(""))).alias("values"), F.countDistinct("evidence_id").alias("evidence"))
    said = passages.select("file_id", F.col("field").alias("dimension"), F.explode(X.numbers(F.col("value"))).alias("number")).distinct()
    shown = passages.select("file_id", F.col("field").alias("dimension"), F.explode(X.numbers(F.col("quote"))).alias("number")).distinct()
    unverified = said.join(shown, ["file_id", "dimension", "number"], "left_anti").select("file_id", "dimension").distinct().withColumn("unverified", F.lit(True))
    keys = ["file_id", "dimension"]
    rows = cells.join(have, keys, "left").join(unverified, keys, "left").select(*keys, F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.col("unverified").isNull().alias("verified"))
    whole = rows.where("values > 0").groupBy("dimension").agg(F.bool_and((F.col("evidence") > 0) & F.col("verified")).alias("concluded"))
    return rows.join(whole, "dimension", "left").withColumn("concluded", F.coalesce("concluded", F.lit(False))).select(*keys, "values", "evidence", "verified", "concluded")


def _key(w: list[str], words: int) -> str:
    """What a holder of the text with words w has as a run of whole words: the first `words`, or all of fewer; of a long text the
    second to the seventh, which few others share. Only a text's first and last words may be parts of its holder's."""
    return " ".join(w[1:7]) if len(w) >= 8 else " ".join(w[:words])


def _firsts(keys: Iterable[str]) -> dict[str, set[int]]:
    """By first word, how many words the keys that begin with it have."""
    found: dict[str, set[int]] = {}
    for key in keys:
        found.setdefault(key.split(" ", 1)[0], set()).add(key.count(" ") + 1)
    return found


def _keys_in(w: list[str], firsts: dict[str, set[int]]) -> set[str]:
    """The runs of w that may be keys."""
    if firsts.keys().isdisjoint(w):
        return set()
    return {" ".join(w[i : i + k]) for i, x in enumerate(w) if x in firsts for k in firsts[x] if i + k <= len(w)}


def _holds(holder: str, text: str, w: list[str], words: int) -> bool:
    return text in holder and f" {' '.join(w[:words])} " in f" {holder} "


def grounded(quotes: DataFrame, pages: DataFrame, words: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """(quote_id, page): the first page of the quote's document that holds the quote or is held by it. quotes (quote_id, doc, text),
    pages (doc, page, text); white space counts as single spaces. A text's first `words` words, or all of fewer, must stand in
    its holder as whole words.

    Texts move once: a document's quotes and pages meet in one task, where the pages stream past the quotes in their order and
    a quote that is found is looked for no more. Documents larger than a share are dealt over a grid of shares of pages and of
    quotes, which loses no pair. sizes (doc, body, quote): the letters of a document's pages and quotes, where the caller knows
    them without reading the texts again; they bear on the dealing alone.
    """
    tidy = lambda df: df.where("doc is not null").withColumn("text", collapse(F.col("text"))).where("text <> ''")
    q, p = tidy(quotes), tidy(pages)
    if sizes is None:
        none = F.lit(0).cast("bigint")
        letters = p.select("doc", F.length("text").alias("body"), none.alias("quote")).unionByName(q.select("doc", none.alias("body"), F.length("text").alias("quote")))
        sizes = letters.groupBy("doc").agg(F.sum("body").alias("body"), F.sum("quote").alias("quote"))
    parts = lambda size, share: F.ceil(F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)) / share).cast("int")
    grid = sizes.where("doc is not null").select("doc", parts(F.col("body"), BODY_SHARE).alias("bodies"), parts(F.col("quote"), QUOTE_SHARE).alias("texts")).where("bodies > 1 or texts > 1")
    # One row for each document above a share: as many as there are shares of text at most.
    dealt = lambda df: df.join(F.broadcast(grid), "doc", "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in ("bodies", "texts")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    kind, key_of = pages.schema["page"].dataType, quotes.schema["quote_id"].dataType
    bodies = dealt(p).select("doc", own("bodies").alias("b"), every("texts").alias("t"), F.lit(2).alias("role"), "page", F.lit(None).cast(key_of).alias("quote_id"), "text")
    asked = dealt(q).select("doc", every("bodies").alias("b"), F.pmod(F.xxhash64("quote_id", "text"), F.col("texts")).cast("int").alias("t"), F.lit(1).alias("role"), F.lit(None).cast(kind).alias("page"), "quote_id", "text")
    # The pages' keys come first, without their texts: runs of quotes are kept only where they are one of these.
    w = F.split("text", " ")
    key = F.when(F.size(w) >= 8, F.array_join(F.slice(w, 2, 6), " ")).otherwise(F.array_join(F.slice(w, 1, words), " "))
    begun = bodies.withColumns({"role": F.lit(0), "page": F.lit(None).cast(kind), "text": key})
    cells = ["doc", "b", "t"]
    rows = begun.unionByName(asked).unionByName(bodies).repartition(*cells).sortWithinPartitions(*cells, "role", F.asc_nulls_last("page"))
    schema = StructType([StructField("quote_id", key_of), StructField("page", kind)])
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(x).to_pylist() for x in (*cells, "role", "page", "quote_id", "text")), strict=True):
                at, (role, page, quote_id, text) = row[:3], row[3:]
                if at != cell:
                    cell, begins, ids, texts, split = at, set(), [], [], []
                    inside: dict[str, list[int]] = {}
                    around: dict[str, list[int]] = {}
                    firsts, begin_firsts, open_ = None, None, []
                if role == 0:
                    begins.add(text)
                    continue
                own_words = text.split(" ")
                if role == 1:
                    if begin_firsts is None:
                        begin_firsts = _firsts(begins)
                    n = len(ids)
                    ids.append(quote_id)
                    texts.append(text)
                    split.append(own_words[:words])
                    open_.append(True)
                    inside.setdefault(_key(own_words, words), []).append(n)
                    for run in _keys_in(own_words, begin_firsts) & begins:
                        around.setdefault(run, []).append(n)
                    continue
                if firsts is None:
                    firsts = _firsts(inside)
                for where, run, held in [(inside, x, False) for x in _keys_in(own_words, firsts)] + [(around, _key(own_words, words), True)]:
                    asking = where.get(run)
                    if not asking:
                        continue
                    left = []
                    for n in asking:
                        if not open_[n]:
                            continue
                        if _holds(texts[n], text, own_words, words) if held else _holds(text, texts[n], split[n], words):
                            open_[n] = False
                            found.append((ids[n], page))
                        else:
                            left.append(n)
                    if len(left) < len(asking):
                        where[run] = left
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(search, schema).groupBy("quote_id").agg(F.min("page").alias("page"))


def evidence_map(materials: DataFrame) -> DataFrame:
    """materials (brief_id, position, kind, source_id, evidence) with statement_id by position and allowed_as_fact: a fact with a
    source and evidence."""
    ok = (F.col("kind") == "fact") & (F.coalesce("source_id", F.lit("")) != "") & (F.col("evidence") > 0)
    return materials.withColumn("statement_id", F.concat(F.lit("statement-"), F.col("position").cast("string"))).withColumn("allowed_as_fact", F.coalesce(ok, F.lit(False)))


def brief_gaps(mapped: DataFrame, points: DataFrame) -> DataFrame:
    """(brief_id, missing): user_points without any in points (brief_id, point), supported_facts without an allowed fact."""
    facts = mapped.groupBy("brief_id").agg(F.max("allowed_as_fact").alias("facts"))
    have = points.where(F.trim("point") != "").select("brief_id").distinct().withColumn("points", F.lit(True))
    return facts.join(have, "brief_id", "left").select("brief_id", F.array_compact(F.array(F.when(F.col("points").isNull(), "user_points"), F.when(~F.col("facts"), "supported_facts"))).alias("missing"))


def review_draft(claims: DataFrame) -> DataFrame:
    """(review_id, draft, errors) of claims (review_id, position, kind, text, source_ids, evidence_ids): facts in order with their
    citations, then inferences marked as such; facts without evidence or source are errors by their place. One review's claims
    are one text, so they are gathered."""
    late = (F.col("kind") == "inference").cast("int")
    rows = claims.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), "position", "text", "source_ids", "evidence_ids"))).alias("c"))
    cite = lambda c: F.trim(F.concat(c["text"], F.lit(" "), F.array_join(F.transform(c["evidence_ids"], lambda e: F.concat(F.lit("["), e, F.lit("]"))), "")))
    line = F.transform("c", lambda c: F.when(c["late"] == 1, F.concat(F.lit("推断："), c["text"])).otherwise(cite(c)))
    wrong = F.flatten(F.transform("c", lambda c, i: F.when(c["late"] == 0, F.array_compact(F.array(F.when(F.size(c["evidence_ids"]) == 0, F.concat(F.lit("claim-"), i.cast("string"), F.lit(": fact has no evidence"))), F.when((F.size(c["evidence_ids"]) == 0) | (F.size(c["source_ids"]) == 0), F.concat(F.lit("claim-"), i.cast("string"), F.lit(": claim is not traceable")))))).otherwise(F.array().cast("array<string>"))))
    return rows.select("review_id", F.array_join(line, " ").alias("draft"), wrong.alias("errors"))


def themed_evidence(themes: DataFrame, statements: DataFrame) -> DataFrame:
    """(review_id, theme, place, statement_id, ...) of themes (review_id, theme, statement_ids): statements of each theme in its
    own order; unknown ids are left out."""
    return themes.select("review_id", "theme", F.posexplode("statement_ids").alias("place", "statement_id")).join(statements, ["review_id", "statement_id"])
