"""Text functions, document structure, memory, event logs and verification, over documents, chunks, requests and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import context as C
from papyrine.operators import structure as D
from papyrine.plans.sql import registered
from papyrine.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def q_sentences(spark, d):
    s = docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("longest"))


def q_numbers(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"(?:^|[^\p{L}\p{N}_])([0-9]+(?:\.[0-9]+)?%?)"), F.lit(1))
    return docs(spark, d).select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, " ").alias("numbers"))


def q_clean_markup(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.trim(F.regexp_replace(F.regexp_replace("text", "<[^<>]+>", " "), "[ \\t\\n\\r]+", " "))).alias("digest"))


def q_fingerprint(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))), 256).alias("fingerprint"))


def q_repeated_lines(spark, d):
    """Lines that stand in at least half of a file's chunks, and in two."""
    c = table(spark, d, "chunks").where("text is not null and file_id is not null").select("file_id", "chunk_id", "text").distinct()
    return D.repeated_lines(c)


def q_chunk_pack(spark, d):
    return D.pack_blocks(docs(spark, d).select("doc_id", F.split("text", "\n").alias("blocks")), "doc_id", "blocks", 700)


def q_section_tree(spark, d):
    return D.section_tree(table(spark, d, "chunks"))


def q_section_closure(spark, d):
    return D.section_closure(table(spark, d, "chunks"))


def q_context_admit(spark, d):
    """Per order the items that fit a context of 100 in quantity, in order, skipping what would exceed it and going on; none of
    them is required (q_context_pack has required ones)."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, d, "lineitem").where("l_quantity is not null").select("l_orderkey", place.alias("o"), F.col("l_quantity").cast("bigint").alias("tokens"))
    taken = C.admitted(items, "l_orderkey", "o", {"tokens": 100})
    return taken.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum(F.col("o.l_quantity").cast("bigint")).alias("tokens"))


PYTHON = {f.__name__: f for f in (q_sentences, q_numbers, q_clean_markup, q_fingerprint, q_repeated_lines, q_chunk_pack, q_section_tree, q_section_closure, q_context_admit)}

_PACKED = r"""recursive blocks as (select doc_id, b, generate_subscripts(bs, 1) - 1 as i from (select doc_id, bs, unnest(bs) as b, bs as bs2 from (select doc_id, string_split(text, chr(10)) as bs from documents where text is not null)) t),
numbered as (select doc_id, unnest(bs) as b, unnest(range(len(bs))) as i from (select doc_id, string_split(text, chr(10)) as bs from documents where text is not null)),
walk(doc_id, i, chunk, size) as (
  select doc_id, i, 0, length(b) from numbered where i = 0
  union all
  select w.doc_id, n.i, case when w.size > 0 and w.size + length(n.b) > 700 then w.chunk + 1 else w.chunk end,
    case when w.size > 0 and w.size + length(n.b) > 700 then length(n.b) else w.size + length(n.b) end from walk w join numbered n on n.doc_id = w.doc_id and n.i = w.i + 1),
packed as (select doc_id, cast(chunk as bigint) as chunk_no, cast(min(i) as bigint) as first_block, count(*) as n_blocks, cast(max(size) as bigint) as n_chars from walk group by doc_id, chunk)"""
_PACKED = "recursive " + _PACKED[_PACKED.index("numbered as"):]
_SECTIONS = r"""paths as (select distinct file_id, section_path from chunks where section_path is not null and len(section_path) > 0 and file_id is not null),
nodes as (select distinct file_id, section_path[1:unnest(range(1, len(section_path) + 1))] as path from paths),
tree as (select file_id, array_to_string(path, ' / ') as path, case when len(path) > 1 then array_to_string(path[1:len(path) - 1], ' / ') end as parent, cast(len(path) as bigint) as level from nodes)"""

_PYTHON_SQL = {
    "q_sentences": r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？.!?])[ \t\n\x0b\f\r]+', '\1<<|>>', 'g'), '(?:<<\|>>|\n)+'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) as s from documents where text is not null)
      select doc_id, cast(len(s) as bigint) as n, cast(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as bigint) as longest from s""",
    "q_numbers": r"""with f as (select doc_id, regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([0-9]+(?:\.[0-9]+)?%?)', 1) as f from documents where text is not null)
      select doc_id, cast(len(f) as bigint) as n, array_to_string(f, ' ') as numbers from f""",
    "q_clean_markup": r"select doc_id, md5(trim(regexp_replace(regexp_replace(text, '<[^<>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) as digest from documents where text is not null",
    "q_fingerprint": r"select doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '))) as fingerprint from documents where text is not null",
    "q_repeated_lines": """with c as (select distinct file_id, chunk_id, text from chunks where text is not null and file_id is not null), n as (select file_id, count(*) as n from c group by file_id),
      l as (select distinct file_id, chunk_id, trim(unnest(string_split(text, chr(10))), ' ') as line from c)
      select file_id, line, count(*) as chunks from l join n using (file_id) where line <> '' group by file_id, line, n.n having count(*) >= greatest(2, (n.n + 1) // 2)""",
    "q_chunk_pack": f"with {_PACKED} select * from packed",
    "q_section_tree": f"with {_SECTIONS} select * from tree",
    "q_section_closure": f"""with recursive {_SECTIONS}, walk as (select file_id, path as root, path as node from tree union select w.file_id, w.root, t.path from walk w join tree t on t.file_id = w.file_id and t.parent = w.node)
      select file_id, root, count(*) - 1 as descendants from walk group by file_id, root""",
    "q_context_admit": """with recursive items as (select l_orderkey, cast(l_quantity as bigint) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k from lineitem),
      walk(l_orderkey, k, used, n, taken) as (
        select l_orderkey, k, case when n <= 100 then n else 0 end, n, n <= 100 from items where k = 1
        union all
        select w.l_orderkey, i.k, case when w.used + i.n <= 100 then w.used + i.n else w.used end, i.n, w.used + i.n <= 100 from walk w join items i on i.l_orderkey = w.l_orderkey and i.k = w.k + 1)
      select l_orderkey, count(*) as kept, cast(sum(n) as bigint) as tokens from walk where taken group by l_orderkey""",
}

_SEQ = "seq as (select user_id, event_id, ts, event_type, value, props, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n from events)"
STATEMENTS: dict[str, str | tuple[str, str]] = {
    # event logs and versioned state
    "q_replay": (
        f"with {_SEQ} select user_id, array_join(transform(array_sort(collect_list(struct(n, event_type))), x -> x.event_type), '>') as path, count(*) as n from seq group by user_id",
        f"with {_SEQ} select user_id, string_agg(event_type, '>' order by n) as path, count(*) as n from seq group by user_id",
    ),
    "q_latest_state": ("select user_id, event_type, max_by(event_id, struct(ts, event_id)) as event_id from events group by user_id, event_type", "select user_id, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) as event_id from events group by user_id, event_type"),
    "q_event_sse": ("select event_id, concat('id: ', cast(event_id as string), '\nevent: ', event_type, '\ndata: ', props, '\n\n') as frame from events", "select event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) as frame from events"),
    "q_redact": ("select event_id, event_type, concat('redacted:', substring(sha2(props, 256), 1, 16), ':', cast(length(props) as string)) as props from events", "select event_id, event_type, 'redacted:' || sha256(props)[1:16] || ':' || length(props) as props from events"),
    # functions over requests
    "q_hash_profile": ("select distinct file_id, cast(conv(substring(sha2(file_id, 256), 1, 8), 16, 10) as bigint) % 3 as profile from render_samples", "select distinct file_id, cast('0x' || sha256(file_id)[1:8] as bigint) % 3 as profile from render_samples"),
    "q_section_number": (
        r"select distinct file_id, chunk_id, array_join(transform(split(regexp_extract(section_path[size(section_path) - 1], '^([0-9.]+)', 1), '[.]'), x -> regexp_replace(x, '^0+', '')), '.') as number from chunks where size(section_path) > 0",
        r"select distinct file_id, chunk_id, array_to_string(list_transform(string_split(regexp_extract(section_path[len(section_path)], '^([0-9.]+)', 1), '.'), lambda x: regexp_replace(x, '^0+', '')), '.') as number from chunks where len(section_path) > 0",
    ),
    "q_resolve_number": (
        r"with s as (select distinct file_id, element_at(section_path, -1) as title, regexp_extract(element_at(section_path, -1), '^([0-9.]+)', 1) as number from chunks where size(section_path) > 0 and file_id is not null), c as (select file_id, number, count(*) as n, min(title) as title from s where number <> '' group by file_id, number) select file_id, number, case when n = 1 then title end as title, n > 1 as ambiguous from c",
        r"with s as (select distinct file_id, section_path[len(section_path)] as title, regexp_extract(section_path[len(section_path)], '^([0-9.]+)', 1) as number from chunks where len(section_path) > 0 and file_id is not null), c as (select file_id, number, count(*) as n, min(title) as title from s where number <> '' group by file_id, number) select file_id, number, case when n = 1 then title end as title, n > 1 as ambiguous from c",
    ),
    "q_resolve_title": (
        r"with s as (select distinct file_id, lower(regexp_replace(element_at(section_path, -1), '^[0-9.]+ *', '')) as title from chunks where size(section_path) > 0 and file_id is not null) select file_id, title, case when title in ('method', 'methods', 'methodology', 'approach') then 'method' when title in ('results', 'findings', 'evaluation') then 'results' else title end as canonical from s",
        r"with s as (select distinct file_id, lower(regexp_replace(section_path[len(section_path)], '^[0-9.]+ *', '')) as title from chunks where len(section_path) > 0 and file_id is not null) select file_id, title, case when title in ('method', 'methods', 'methodology', 'approach') then 'method' when title in ('results', 'findings', 'evaluation') then 'results' else title end as canonical from s",
    ),
    # verification
    "q_set_f1": (
        "with t as (select distinct sample_id, array_distinct(filter(coalesce(paper_ids, array()), x -> x is not null)) as a, array_distinct(filter(coalesce(conversation_ids, array()), x -> x is not null)) as b from training_samples) select sample_id, case when size(a) = 0 and size(b) = 0 then null when size(array_intersect(a, b)) = 0 then 0e0 else round(2e0 * size(array_intersect(a, b)) / (size(a) + size(b)), 9) end as f1 from t",
        "with t as (select distinct sample_id, list_distinct(list_filter(coalesce(paper_ids, []), lambda x: x is not null)) as a, list_distinct(list_filter(coalesce(conversation_ids, []), lambda x: x is not null)) as b from training_samples), u as (select distinct sample_id, len(a) as a, len(b) as b, len(list_intersect(a, b)) as i from t) select sample_id, case when a = 0 and b = 0 then null when i = 0 then 0e0 else round(2e0 * i / (a + b), 9) end as f1 from u",
    ),
    # spans of texts against queries and evidence
    "q_uninvert": (
        "with w as (select doc_id, posexplode(split(text, ' ')) as (pos, word) from documents where text is not null), inv as (select doc_id, word, collect_list(pos) as positions from w group by doc_id, word), back as (select doc_id, word, explode(positions) as pos from inv) select doc_id, md5(array_join(transform(array_sort(collect_list(struct(pos, word))), x -> x.word), ' ')) as digest from back group by doc_id",
        "select doc_id, md5(text) as digest from documents where text is not null",
    ),
    # windows over the event stream: additions of this engine
    "q_ext_windows": (
        "select cast(window(ts, '1 day').start as string) as day, event_type, count(*) as n, sum(cast(round(value * 100) as bigint)) as cents from events group by window(ts, '1 day'), event_type",
        "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as day, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by date_trunc('day', ts), event_type",
    ),
}

_queries, _sql = registered(STATEMENTS)
QUERIES = PYTHON | _queries
SQL = _PYTHON_SQL | _sql
