"""Joins, set operations, aggregates, ranking and evaluation tables."""

from __future__ import annotations

from collections.abc import Callable

from papyrine.plans.sql import registered

_CASES = "cases as (select distinct case_id, task_family, difficulty, split, language, paper_type, prompt, source_id, source_cluster_id, authorization_status, text_fingerprint, usable_for_training from eval_cases)"


def _split(letters: str) -> Callable[[str], str]:
    """The statement's norm_split, given how the engine drops all but letters."""
    return lambda c: (lambda w: f"case when {w} in ('train', 'training') then 'train' when {w} in ('validation', 'val', 'dev', 'valid') then 'validation' when {w} = 'test' then 'test' end")(f"lower({letters.format(c)})")


STATEMENTS: dict[str, str | tuple[str, str]] = {
    # joins
    "q_range_join": tuple(
        f"""with c as (select distinct chunk_id, file_id, page_start, page_end from chunks where file_id is not null and page_start is not null), ranges as (select file_id, chunk_id, {pages} as page from c where page_end > page_start)
          select distinct r.chunk_id as a, c.chunk_id as b from ranges r join c on c.file_id = r.file_id and c.page_start = r.page and c.chunk_id <> r.chunk_id"""
        for pages in ("explode(sequence(page_start, page_end))", "unnest(range(page_start, page_end + 1))")
    ),
    # sets, ranking, batches
    "q_stratified_sample": (
        f"with {_CASES}, h as (select case_id, task_family, sha2(case_id, 256) as h from cases), r as (select *, row_number() over (partition by task_family order by h) as k from h) select case_id, task_family from r where k <= 5",
        f"with {_CASES}, h as (select case_id, task_family, sha256(case_id) as h from cases), r as (select *, row_number() over (partition by task_family order by h) as k from h) select case_id, task_family from r where k <= 5",
    ),
    # keys, audits, governance
    # every key that both tables hold; no column holds an embedding cluster. Splits as in norm_split
    "q_leakage_all": tuple(
        f"""with rows as (select distinct 'eval_cases' as t, case_id as id, {norm("split")} as split, paper_ids, conversation_ids, source_cluster_id, text_fingerprint from eval_cases
          union select 'training_samples', sample_id, {norm("dataset_split")}, paper_ids, conversation_ids, cast(null as {string}), cast(null as {string}) from training_samples),
          keys as (select t, id, split, 'paper' as kind, {each}(paper_ids) as k from rows union select t, id, split, 'conversation', {each}(conversation_ids) from rows
          union select t, id, split, 'source', source_cluster_id from rows union select t, id, split, 'fingerprint', text_fingerprint from rows)
          select t, kind, k, count(distinct split) as splits, count(*) as n from keys where k is not null and split is not null group by t, kind, k having count(distinct split) > 1"""
        for norm, each, string in ((_split("regexp_replace({}, '[^A-Za-z]', '')"), "explode", "string"), (_split("regexp_replace({}, '[^A-Za-z]', '', 'g')"), "unnest", "varchar"))
    ),
    "q_blob_refcount": (
        "select sha2(text, 256) as digest, source, count(*) as refs from documents where text is not null group by sha2(text, 256), source",
        "select sha256(text) as digest, source, count(*) as refs from documents where text is not null group by sha256(text), source",
    ),
}

QUERIES, SQL = registered(STATEMENTS)
