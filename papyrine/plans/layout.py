"""Queries over layout, sections and the index, and the same in SQL written on its own. Blocks are the chunks' boxes on pages of
600 by 800, or the chunks' lines in order, with a size of type that follows from their length."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.operators import layout as L
from papyrine.sources.tables import table


def boxes(spark, d):
    c = table(spark, d, "chunks").where("bbox is not null and page_start is not null and file_id is not null and text is not null").select("chunk_id", "file_id", "page_start", "bbox", "text").distinct()
    b = [F.col("bbox")[i] for i in range(4)]
    return c.select(F.col("file_id").alias("doc"), F.col("page_start").alias("page"), F.col("chunk_id").alias("block_id"), F.trim(F.split("text", "\n")[0]).alias("text"), b[0].alias("x0"), (b[1] - 5).alias("y0"), b[2].alias("x1"), b[3].alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


def lines(spark, d):
    c = table(spark, d, "chunks").where("page_start is not null and file_id is not null and text is not null").select("chunk_id", "file_id", "page_start", "text").distinct()
    rows = c.select(F.col("file_id").alias("doc"), F.col("page_start").alias("page"), "chunk_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    order = Window.partitionBy("doc").orderBy("page", "chunk_id", "i")
    return rows.select("doc", "page", "chunk_id", "i", "text", (F.row_number().over(order) - 1).alias("pos"), (8.0 + F.length("text") % 5).alias("font_size"), (F.length("text") % 7 == 0).alias("is_bold"))


def q_column_count(spark, d):
    return L.column_counts(boxes(spark, d)).select(F.col("doc").alias("file_id"), F.col("page").alias("page_start"), "columns")


def q_reading_order(spark, d):
    return L.reading_order(boxes(spark, d)).select(F.col("block_id").alias("chunk_id"), "position")


def q_margin_roles(spark, d):
    return L.margin_roles(boxes(spark, d)).select(F.col("block_id").alias("chunk_id"), "role")


def q_toc_pages(spark, d):
    """Pages of contents: pages whose first line is taken as that title where the file's page number divides by three."""
    b = lines(spark, d)
    marked = b.withColumn("text", F.when((F.col("page") % 3 == 0) & (F.col("i") == 0), F.lit(" Contents")).otherwise(F.col("text")))
    return L.toc_pages(marked)


def q_headings(spark, d):
    b = lines(spark, d)
    p = L.heading_parts(F.col("text"))
    found = b.where(L.is_heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.lit(10.0)))
    return found.select("doc", F.col("pos").cast("bigint").alias("pos"), p["number"].alias("number"), p["level"].alias("level"), F.md5(p["title"]).alias("title"), F.md5(L.plain_title(F.col("text"))).alias("plain"))


def q_heading_tree(spark, d):
    t = L.section_tree(lines(spark, d))
    return t.select("doc", F.col("ordinal").cast("bigint").alias("ordinal"), "number", "level", F.col("parent").cast("bigint").alias("parent"), F.md5(F.array_join("path", " / ")).alias("path"), "page_start", "page_end", "direct", "below")


def _sections(spark, d):
    c = table(spark, d, "chunks").where("file_id is not null and page_start is not null and size(section_path) > 0").select("file_id", "chunk_id", "page_start", "page_end", F.array_join("section_path", " / ").alias("section")).distinct()
    s = c.groupBy(F.col("file_id").alias("doc"), F.col("section").alias("section_id")).agg(F.min("page_start").alias("page_start"), F.max(F.coalesce("page_end", "page_start")).alias("page_end"), F.collect_set("chunk_id").alias("block_ids"), F.min("chunk_id").alias("first"))
    return s.withColumn("ordinal", F.struct("first", "section_id"))


def _captions(spark, d):
    b = boxes(spark, d)
    return b.where(F.col("text").rlike(L.CAPTION)).select("doc", "page", F.col("block_id").alias("caption_id"), F.when(F.length("text") % 3 == 0, "algorithm").otherwise(F.lower(F.regexp_extract("text", L.CAPTION, 1))).alias("kind"), "x0", "y0", "x1", "y1")


def q_artifact_sections(spark, d):
    """Every box as an artifact: the section it belongs to."""
    a = boxes(spark, d).select("doc", F.col("block_id").alias("artifact_id"), "page", F.array("block_id").alias("block_ids"))
    return L.attach_sections(a, _sections(spark, d)).select("artifact_id", "section_id")


def q_caption_regions(spark, d):
    """Boxes as captions, those with an even length of text, and the others as regions."""
    b = boxes(spark, d)
    even = F.length("text") % 2 == 0
    captions = b.where(even).select("doc", "page", F.col("block_id").alias("caption_id"), F.when(F.length("text") % 3 == 0, "algorithm").otherwise("figure").alias("kind"), "x0", "y0", "x1", "y1")
    found = L.nearest_regions(captions, b.where(~even).select("doc", "page", F.col("block_id").alias("region_id"), "x0", "y0", "x1", "y1"))
    return found.select("caption_id", "region_id", F.round("distance", 6).alias("distance"))


def q_captions(spark, d):
    b = lines(spark, d).where(F.col("text").rlike(L.CAPTION))
    part = lambda i: F.regexp_extract("text", L.CAPTION, i)
    return b.select("doc", F.col("pos").cast("bigint").alias("pos"), F.lower(part(1)).alias("kind"), part(2).alias("number"), F.md5(part(3)).alias("title"))


def q_chunk_agg(spark, d):
    """Rows of each file and section put together from its chunks: text, pages, box, blocks in order."""
    c = table(spark, d, "chunks").where("bbox is not null and page_start is not null and file_id is not null and text is not null and size(section_path) > 0").select("file_id", F.array_join("section_path", " / ").alias("section"), "chunk_id", "page_start", "bbox", "text").distinct()
    b = c.select("file_id", "section", "page_start", F.col("page_start").alias("page"), F.col("chunk_id").alias("block_id"), "text", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).drop("page_start")
    r = L.chunk_rows(b, ["file_id", "section", "page"], ["block_id"])
    return r.select("file_id", "section", "page", F.md5("text").alias("text"), F.array_join("block_ids", ",").alias("blocks"), "page_start", "page_end", "x0", "y0", "x1", "y1")


def q_parent_chunks(spark, d):
    """One parent chunk per section: its title, then its chunks' texts in order."""
    c = table(spark, d, "chunks").where("file_id is not null and text is not null and size(section_path) > 0").select("file_id", "section_path", "chunk_id", "text", "page_start", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1")).distinct()
    r = L.chunk_rows(c.select("file_id", "section_path", F.col("chunk_id").alias("block_id"), "text", F.col("page_start").alias("page"), "x0", "y0", "x1", "y1"), ["file_id", "section_path"], ["block_id"])
    return r.select("file_id", F.array_join("section_path", " / ").alias("section"), F.md5(F.concat(F.try_element_at("section_path", F.lit(-1)), F.lit("\n"), F.col("text"))).alias("text"), F.size("block_ids").cast("bigint").alias("children"))


def q_searchable(spark, d):
    c = table(spark, d, "chunks").where("text is not null").select("chunk_id", "section_path", "text").distinct()
    return c.select("chunk_id", F.md5(L.scrub(L.searchable(F.col("section_path"), F.col("text")))).alias("digest"))


def q_fallback_section(spark, d):
    c = table(spark, d, "chunks").where("file_id is not null").select("file_id", "chunk_id", "section_path").distinct()
    sections = c.where("size(section_path) > 0 and substring(chunk_id, -1, 1) = '7'").groupBy(F.col("file_id").alias("doc"), F.col("section_path").alias("path")).agg(F.count("*").alias("blocks"))
    return L.with_fallback_section(c.select(F.col("file_id").alias("doc")), sections).select("doc", F.array_join("path", " / ").alias("path"), "blocks")


def q_index_plan(spark, d):
    """What to do with each rendered file: its content is taken as indexed where its page count isn't divisible by five, with the
    version 4 but where divisible by seven."""
    r = table(spark, d, "render_samples").where("file_id is not null").groupBy("file_id").agg(F.min("sha256").alias("sha256"), F.max("page_count").alias("n"))
    old = r.where("n % 5 <> 0").select("file_id", F.when(F.col("n") % 11 == 0, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("n") % 7 == 0, 3).otherwise(4).alias("index_version"), F.lit(1).alias("schema_version"))
    c = table(spark, d, "chunks").where("file_id is not null").select("file_id", "chunk_id", "text", "section_path").distinct()
    rows = c.select("file_id", F.col("text").isNotNull().alias("ready"), F.lit("hash:64").alias("fingerprint"), F.when(F.size("section_path") > 0, F.col("section_path")[0]).otherwise("unknown").alias("section"))
    return L.index_plan(r, old, rows, 4, 1, F.lit("hash:64"))


def q_delete_index(spark, d):
    """What is left of the chunks per file once the index of degraded scans is deleted."""
    gone = table(spark, d, "render_samples").where("lower(profile) like '%degraded%'").select("file_id").distinct()
    return table(spark, d, "chunks").where("file_id is not null").join(gone, "file_id", "left_anti").groupBy("file_id").agg(F.countDistinct("chunk_id").alias("chunks"))


def q_length_class(spark, d):
    c = table(spark, d, "chunks").where("file_id is not null and text is not null").select("file_id", "chunk_id", "text").distinct()
    s = c.groupBy("file_id").agg(F.sum(F.length("text")).alias("chars"))
    return s.select("file_id", "chars", F.when(F.col("chars") >= 30_000, "long_paper").otherwise("short_paper").alias("length_class"))


def q_scan_scoped(spark, d):
    """Chunks in a scope of files and sections, without a filter, and in an empty scope: rows of each."""
    c = table(spark, d, "chunks").select("chunk_id", "file_id", F.array_join("section_path", " / ").alias("section")).distinct()
    files = table(spark, d, "render_samples").where("lower(profile) like '%degraded%'").select("file_id")
    sections = c.where("section like '2%'").select("section")
    cases = {"files": L.scoped(c, files), "files and sections": L.scoped(c, files, sections), "no filter": L.scoped(c), "empty": L.scoped(c, files.limit(0))}
    rows = None
    for name, x in cases.items():
        one = x.agg(F.count("*").alias("chunks"), F.count("file_id").alias("with_file")).select(F.lit(name).alias("scope"), "chunks", "with_file")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def q_section_catalog(spark, d):
    """The sections of each file in order of where they begin."""
    c = table(spark, d, "chunks").where("file_id is not null and size(section_path) > 0").groupBy("file_id", F.array_join("section_path", " / ").alias("section")).agg(F.min("chunk_id").alias("first"))
    w = Window.partitionBy("file_id").orderBy("first", "section")
    return c.select("file_id", "section", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


def _pages(spark, d):
    t = table(spark, d, "chunks").where("file_id is not null and page_start is not null").select("file_id", "chunk_id", "page_start", "text").distinct()
    return t.groupBy(F.col("file_id").alias("doc"), F.col("page_start").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def q_page_flatten(spark, d):
    """A file's pages as one array, flattened again with page numbers by place, from 1."""
    nested = _pages(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return nested.select("doc", F.posexplode("pages").alias("i", "p")).select("doc", (F.col("i") + 1).cast("bigint").alias("page_number"), F.md5("p.text").alias("digest"))


def q_parse_quality(spark, d):
    q = L.parse_quality(_pages(spark, d))
    return q.select("doc", F.round("score", 9).alias("score"), "characters", F.round("empty_ratio", 9).alias("empty_ratio"), F.array_join("warnings", ",").alias("warnings"))


def q_ocr_select(spark, d):
    """Pages with too little text and three engines whose confidence follows from the page's length."""
    pages = _pages(spark, d).withColumn("text", F.when(F.length("text") % 3 == 0, F.lit(" few ")).otherwise(F.col("text")))
    n = F.length(F.md5(F.concat("doc", F.col("page").cast("string"))))
    n = F.conv(F.substring(F.md5(F.concat("doc", F.lit("-"), F.col("page").cast("string"))), 1, 4), 16, 10).cast("int")
    e = pages.select("doc", "page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    readings = e.select("doc", "page", F.concat(F.lit("engine"), F.floor(F.col("k") / 2).cast("string")).alias("engine"), F.floor(F.col("k") / 2).alias("priority"), ((n + F.col("k") * 37) % 100 / 100.0).alias("confidence"))
    return L.choose_reading(pages, readings)


QUERIES = {f.__name__: f for f in (q_column_count, q_reading_order, q_margin_roles, q_toc_pages, q_headings, q_heading_tree, q_artifact_sections, q_caption_regions, q_captions, q_chunk_agg, q_parent_chunks, q_searchable, q_fallback_section, q_index_plan, q_delete_index, q_length_class, q_scan_scoped, q_section_catalog, q_page_flatten, q_parse_quality, q_ocr_select)}

_B = """c as (select distinct chunk_id, file_id, page_start, bbox, text from chunks where bbox is not null and page_start is not null and file_id is not null and text is not null),
b as (select file_id as doc, page_start as page, chunk_id as id, trim(string_split(text, chr(10))[1], ' ') as text, bbox[1] as x0, bbox[2] - 5 as y0, bbox[3] as x1, bbox[4] as y1 from c)"""
_COLS = """side as (select *, case when y0 > 48 and y1 < 752 and x1 - x0 <= 348 then case when (x0 + x1) / 2 < 276 then 'l' when (x0 + x1) / 2 > 324 then 'r' end end as s from b),
s as (select doc, page, count(*) filter (s = 'l') as l, count(*) filter (s = 'r') as r, median(x1) filter (s = 'l') as lx, median(x0) filter (s = 'r') as rx, min(y0) filter (s = 'l') as l0, max(y1) filter (s = 'l') as l1, min(y0) filter (s = 'r') as r0, max(y1) filter (s = 'r') as r1 from side group by doc, page),
cols as (select doc, page, cast(case when l >= 2 and r >= 2 and rx - lx >= 9 and greatest(0, least(l1, r1) - greatest(l0, r0)) / greatest(1, least(l1 - l0, r1 - r0)) >= 0.35 then 2 else 1 end as int) as columns from s)"""
_L = """c as (select distinct chunk_id, file_id, page_start, text from chunks where page_start is not null and file_id is not null and text is not null),
l as (select file_id as doc, page_start as page, chunk_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as i from c),
b as (select *, row_number() over (partition by doc order by page, chunk_id, i) - 1 as pos, 8.0 + length(text) % 5 as font, length(text) % 7 = 0 as bold from l)"""
_NUM, _APP = r"(?i)^(?:(?:chapter|section)\s+)?(\d+(?:\.\d+)*|[A-Z](?:\.\d+)*|[IVXLC]+)[\s.:\-]+([^.].{1,158})$", r"(?i)^appendix\s+([A-Z](?:\.\d+)*)[\s.:\-]+(.{2,150})$"
_PLAIN = r"trim(regexp_replace(lower(regexp_replace(trim({0}, ' '), '(?i)^(appendix\s+)?(\d+(\.\d+)*|[A-Z](\.\d+)*|[IVXLC]+)[\s.:\-]+', '')), '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'), ' ')"
_TITLES = "['abstract','摘要','introduction','引言','related work','literature review','相关工作','background','背景','method','methods','methodology','materials and methods','方法','experiments','experimental setup','实验','results','findings','结果','discussion','讨论','conclusion','conclusions','结论','references','参考文献','appendix','supplementary material','附录']"


def _heads(baseline: str) -> str:
    return rf"""p as (select *, trim(text, ' ') as t, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') as clean, {_PLAIN.format("text")} as plain0 from b),
n as (select *, case when regexp_matches(clean, '{_APP}') then upper(regexp_extract(clean, '{_APP}', 1)) when regexp_matches(clean, '{_NUM}') then upper(regexp_extract(clean, '{_NUM}', 1)) end as number,
  case when regexp_matches(clean, '{_APP}') then trim(regexp_extract(clean, '{_APP}', 2), ' .:-') when regexp_matches(clean, '{_NUM}') then trim(regexp_extract(clean, '{_NUM}', 2), ' .:-') else clean end as title0, {baseline} as base from p),
h as (select *, coalesce(length(number) - length(replace(number, '.', '')) + 1, 1) as level from n where t <> '' and length(t) <= 160 and not regexp_matches(plain0, '^(figure |fig\. |table )') and not regexp_matches(t, '(?i)^\d+\s+[\p{{L}}\p{{N}}\p{{M}}_]+\s+et\s+al\.')
  and not (suffix(t, '.') and not list_contains({_TITLES}, plain0)) and (number is not null or list_contains({_TITLES}, plain0) or ((font >= base * 1.22 or (bold and font >= base)) and len(regexp_split_to_array(title0, '\s+')) <= 14)))"""


_CAP = r"(?i)^(figure|fig\.?|图|table|表|algorithm|算法)\s*([A-Z]?\d+(?:[.\-]\d+)*)?\s*[:.：\-]?\s*(.*)$"
_SEC = """sc as (select distinct file_id as doc, chunk_id, page_start, page_end, array_to_string(section_path, ' / ') as section from chunks where file_id is not null and page_start is not null and len(section_path) > 0),
sec as (select doc, section, min(page_start) as p0, max(coalesce(page_end, page_start)) as p1, list(distinct chunk_id) as ids, min(chunk_id) as first from sc group by doc, section)"""
_P = """t as (select distinct file_id as doc, chunk_id, page_start as page, text from chunks where file_id is not null and page_start is not null),
pages as (select doc, page, string_agg(coalesce(text, ''), chr(10) order by chunk_id, text nulls first) as text from t group by doc, page)"""

SQL = {
    "q_column_count": f"with {_B}, {_COLS} select doc as file_id, page as page_start, columns from cols",
    "q_reading_order": f"""with {_B}, {_COLS}, z as (select b.*, columns, y0 > 40 and y1 < 760 as body, x1 - x0 <= 372 as narrow from b join cols using (doc, page)),
      f as (select *, min(y0) filter (body and narrow) over (partition by doc, page) as first from z),
      k as (select *, case when columns = 1 then 0 when not body then case when y0 <= 40 then 0 else 5 end when narrow then case when (x0 + x1) / 2 < 300 then 2 else 3 end when y0 < first then 1 else 4 end as zone from f)
      select id as chunk_id, row_number() over (partition by doc, page order by zone, case when columns = 2 and zone in (0, 5) then 0 else y0 end, x0, id) as position from k""",
    "q_margin_roles": f"""with {_B}, n as (select doc, greatest(2, (count(distinct page) + 1) // 2) as least from b group by doc),
      hs as (select doc, text from b join n using (doc) where y0 <= 40 group by doc, text, least having count(*) >= least), fs as (select doc, text from b join n using (doc) where y1 >= 760 group by doc, text, least having count(*) >= least or starts_with(lower(text), 'page '))
      select id as chunk_id, case when y0 <= 40 or exists (select 1 from hs where hs.doc = b.doc and hs.text = b.text) then 'header' when y1 >= 760 or exists (select 1 from fs where fs.doc = b.doc and fs.text = b.text) then 'footer' else 'body' end as role from b""",
    "q_toc_pages": rf"with {_L}, m as (select doc, page, lower(trim(case when page % 3 = 0 and i = 0 then ' Contents' else text end, ' ')) as t from b) select doc, page from m group by doc, page having count(*) filter (t in ('contents', 'table of contents', '目录')) > 0 and count(*) filter (regexp_matches(t, '.{{2,}}\s*\d+\s*$')) >= 2",
    "q_headings": f"with {_L}, {_heads('10.0')} select doc, pos, number, cast(level as int) as level, md5(title0) as title, md5(plain0) as plain from h",
    "q_heading_tree": f"""with recursive {_L}, base as (select doc, list_sort(list(font))[count(*) // 2 + 1] as bl, count(*) as blocks from b group by doc), {_heads("(select bl from base where base.doc = p.doc)")},
      o as (select doc, pos, page, t, number, level, row_number() over (partition by doc order by pos) - 1 as ordinal from h),
      par as (select x.doc, x.ordinal, max(y.ordinal) as parent from o x left join o y on y.doc = x.doc and y.ordinal < x.ordinal and y.level < x.level group by x.doc, x.ordinal),
      fin as (select x.doc, x.ordinal, min(y.pos) as stop, min(y.ordinal) as stop_o from o x left join o y on y.doc = x.doc and y.ordinal > x.ordinal and y.level <= x.level group by x.doc, x.ordinal),
      nxt as (select doc, ordinal, lead(pos) over (partition by doc order by pos) as next_pos, count(*) over (partition by doc) as heads from o),
      path as (select o.doc, o.ordinal, o.t as path from o join par using (doc, ordinal) where parent is null union all select o.doc, o.ordinal, path.path || ' / ' || o.t from o join par using (doc, ordinal) join path on path.doc = par.doc and path.ordinal = par.parent)
      select o.doc, o.ordinal, o.number, cast(o.level as int) as level, par.parent, md5(path.path) as path, o.page as page_start, greatest(o.page, b.page) as page_end, coalesce(next_pos, blocks) - o.pos - 1 as direct,
        coalesce(stop, blocks) - o.pos - 1 - (coalesce(stop_o, heads) - o.ordinal - 1) - (coalesce(next_pos, blocks) - o.pos - 1) as below
      from o join par using (doc, ordinal) join fin using (doc, ordinal) join nxt using (doc, ordinal) join path using (doc, ordinal) join base using (doc) left join b on b.doc = o.doc and b.pos = coalesce(stop, blocks) - 1""",
    "q_artifact_sections": f"with {_B}, {_SEC}, m as (select id, section, case when list_contains(ids, id) then 1 else 0 end as shared, first from b left join sec on sec.doc = b.doc and b.page between p0 and greatest(p0, p1)) select id as artifact_id, section as section_id from (select *, row_number() over (partition by id order by shared desc, first desc nulls last, section desc) as r from m) x where r = 1",
    "q_caption_regions": f"""with {_B}, m as (select c.id as caption_id, r.id as region_id, r.x0 <= c.x0 and r.y0 <= c.y0 and r.x1 >= c.x1 and r.y1 >= c.y1 as holds,
        least(abs(c.y0 - r.y1), abs(r.y0 - c.y1)) + 0.4 * greatest(0, greatest(c.x0, r.x0) - least(c.x1, r.x1)) as far, length(c.text) % 3 = 0 as algo from b c join b r on c.doc = r.doc and c.page = r.page where length(c.text) % 2 = 0 and length(r.text) % 2 = 1),
      k as (select *, far - case when algo and holds then 1000 else 0 end as dist from m) select caption_id, region_id, round(dist, 6) as distance from (select *, row_number() over (partition by caption_id order by dist, region_id) as n from k) x where n = 1 and (dist <= 90 or holds)""",
    "q_captions": f"with {_L} select doc, pos, lower(regexp_extract(text, '{_CAP}', 1)) as kind, regexp_extract(text, '{_CAP}', 2) as number, md5(regexp_extract(text, '{_CAP}', 3)) as title from b where regexp_matches(text, '{_CAP}')",
    "q_chunk_agg": """with c as (select distinct file_id, array_to_string(section_path, ' / ') as section, chunk_id, page_start as page, bbox, text from chunks where bbox is not null and page_start is not null and file_id is not null and text is not null and len(section_path) > 0)
      select file_id, section, page, md5(string_agg(text, chr(10) order by chunk_id)) as text, string_agg(chunk_id, ',' order by chunk_id) as blocks, min(page) as page_start, max(page) as page_end, min(bbox[1]) as x0, min(bbox[2]) as y0, max(bbox[3]) as x1, max(bbox[4]) as y1 from c group by file_id, section, page""",
    "q_parent_chunks": "with c as (select distinct file_id, section_path, chunk_id, text, page_start from chunks where file_id is not null and text is not null and len(section_path) > 0) select file_id, array_to_string(section_path, ' / ') as section, md5(section_path[len(section_path)] || chr(10) || string_agg(text, chr(10) order by chunk_id)) as text, count(*) as children from c group by file_id, section_path",
    "q_searchable": "select distinct chunk_id, md5(replace(array_to_string(coalesce(section_path, []), ' / ') || chr(10) || text, chr(0), '')) as digest from chunks where text is not null",
    "q_fallback_section": "with c as (select distinct file_id, chunk_id, section_path from chunks where file_id is not null), s as (select file_id as doc, array_to_string(section_path, ' / ') as path, count(*) as blocks from c where len(section_path) > 0 and right(chunk_id, 1) = '7' group by file_id, section_path) select * from s union all select file_id, 'Document', count(*) from c where file_id not in (select doc from s) group by file_id",
    "q_index_plan": """with r as (select file_id, min(sha256) as sha, max(page_count) as n from render_samples where file_id is not null group by file_id), c as (select file_id, count(*) as all_, count(*) filter (text is not null and len(section_path) > 0 and section_path[1] <> 'unknown') as good from (select distinct file_id, chunk_id, text, section_path from chunks) x group by file_id)
      select r.file_id, case when n is null or n % 5 = 0 or sha is null and n % 11 <> 0 then 'build' when n % 11 <> 0 and n % 7 <> 0 and all_ = good then 'reuse' else 'rebuild' end as action from r left join c using (file_id)""",
    "q_delete_index": "select file_id, count(distinct chunk_id) as chunks from chunks where file_id is not null and file_id not in (select file_id from render_samples where file_id is not null and contains(lower(profile), 'degraded')) group by file_id",
    "q_length_class": "with c as (select distinct file_id, chunk_id, text from chunks where file_id is not null and text is not null) select file_id, cast(sum(length(text)) as bigint) as chars, case when sum(length(text)) >= 30000 then 'long_paper' else 'short_paper' end as length_class from c group by file_id",
    "q_scan_scoped": """with c as (select distinct chunk_id, file_id, array_to_string(section_path, ' / ') as section from chunks), f as (select distinct file_id from render_samples where contains(lower(profile), 'degraded'))
      select 'files' as scope, count(*) as chunks, count(file_id) as with_file from c where file_id in (select file_id from f) union all select 'files and sections', count(*), count(file_id) from c where file_id in (select file_id from f) and section in (select section from c where starts_with(section, '2'))
      union all select 'no filter', count(*), count(file_id) from c union all select 'empty', 0, 0""",
    "q_section_catalog": "with s as (select file_id, array_to_string(section_path, ' / ') as section, min(chunk_id) as first from chunks where file_id is not null and len(section_path) > 0 group by 1, 2) select file_id, section, row_number() over (partition by file_id order by first, section) - 1 as ordinal from s",
    "q_page_flatten": f"with {_P} select doc, row_number() over (partition by doc order by page, text) as page_number, md5(text) as digest from pages",
    "q_parse_quality": f"""with {_P}, q as (select doc, count(*) as n, sum(length(text)) as ch, count(*) filter (trim(text, ' ') = '') as e from pages group by doc), s as (select *, 0.7 * least(1.0, ch / (n * 100.0)) + 0.3 * (1 - e / n) as score from q)
      select doc, round(score, 9) as score, cast(ch as bigint) as characters, round(e / n, 9) as empty_ratio, concat_ws(',', case when e > 0 then 'one_or_more_pages_have_no_extracted_text' end, case when score < 0.6 then 'low_text_extraction_quality' end) as warnings from s""",
    "q_ocr_select": f"""with {_P}, p as (select doc, page, case when length(text) % 3 = 0 then 'few' else trim(text, ' ') end as t, cast('0x' || md5(doc || '-' || page)[1:4] as int) as n from pages),
      e as (select doc, page, e, (((n + e * 2 * 37) % 100) / 100.0 + ((n + (e * 2 + 1) * 37) % 100) / 100.0) / 2 as mean from p cross join range(3) r(e)), f as (select doc, page, min(e) filter (mean >= 0.55) as first from e group by doc, page)
      select doc, page, case when length(t) >= 20 then 'text' else 'engine' || coalesce(first, 2) end as engine from p join f using (doc, page)""",
}
