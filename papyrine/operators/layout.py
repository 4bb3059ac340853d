"""From blocks on pages to sections and chunks: columns, reading order, margins, headings, section trees, captions, index rows.

A block is a row (doc, page, block_id, text, x0, y0, x1, y1, width, height) with font_size and is_bold where headings are told;
width and height are the page's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.plans.runtime import cut

# Patterns and titles whose values decide results (fixed values).
NUMBERED = r"(?i)^(?:(?:chapter|section)\s+)?(\d+(?:\.\d+)*|[A-Z](?:\.\d+)*|[IVXLC]+)[\s.:\-]+([^.].{1,158})$"
APPENDIX = r"(?i)^appendix\s+([A-Z](?:\.\d+)*)[\s.:\-]+(.{2,150})$"
NUMBER_PREFIX = r"(?i)^(?:appendix\s+)?(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)*|[IVXLC]+)[\s.:\-]+"
COMMON_TITLES = (
    "abstract", "摘要", "introduction", "引言", "related work", "literature review", "相关工作", "background", "背景", "method", "methods", "methodology", "materials and methods", "方法",
    "experiments", "experimental setup", "实验", "results", "findings", "结果", "discussion", "讨论", "conclusion", "conclusions", "结论", "references", "参考文献", "appendix",
    "supplementary material", "附录",
)
CAPTION = r"(?i)^(figure|fig\.?|图|table|表|algorithm|算法)\s*([A-Z]?\d+(?:[.\-]\d+)*)?\s*[:.：\-]?\s*(.*)$"
CONTENTS = ("contents", "table of contents", "目录")


def column_counts(blocks: DataFrame) -> DataFrame:
    """(doc, page, columns): two where narrow blocks inside the page's body stand left and right of a gutter and side by side for
    a third of the shorter side's height, else one. Conditional aggregates, combined map-side but for the two medians."""
    w, h = F.col("width"), F.col("height")
    inside = (F.col("y0") > h * 0.06) & (F.col("y1") < h * 0.94) & (F.col("x1") - F.col("x0") <= w * 0.58)
    middle = (F.col("x0") + F.col("x1")) / 2
    left, right = inside & (middle < w / 2 * 0.92), inside & (middle > w / 2 * 1.08)
    side = lambda is_, c: F.when(is_, F.col(c))
    s = blocks.groupBy("doc", "page").agg(
        F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.median(side(left, "x1")).alias("lx"), F.median(side(right, "x0")).alias("rx"), F.max("width").alias("w"),
        F.min(side(left, "y0")).alias("l0"), F.max(side(left, "y1")).alias("l1"), F.min(side(right, "y0")).alias("r0"), F.max(side(right, "y1")).alias("r1"),
    )
    overlap = F.greatest(F.lit(0.0), F.least("l1", "r1") - F.greatest("l0", "r0"))
    shorter = F.greatest(F.lit(1.0), F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0")))
    two = (F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("rx") - F.col("lx") >= F.col("w") * 0.015) & (overlap / shorter >= 0.35)
    return s.select("doc", "page", F.when(two, 2).otherwise(1).cast("int").alias("columns"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc, page, block_id, position) from 1. One column: from top to bottom. Two: the top margin, what spans the page above the
    columns, the left column, the right one, what else spans the page, the bottom margin."""
    w, h, middle = F.col("width"), F.col("height"), (F.col("x0") + F.col("x1")) / 2
    body = (F.col("y0") > h * 0.05) & (F.col("y1") < h * 0.95)
    narrow = body & (F.col("x1") - F.col("x0") <= w * 0.62)
    first = F.min(F.when(narrow, F.col("y0"))).over(Window.partitionBy("doc", "page"))
    zone = F.when(~body, F.when(F.col("y0") <= h * 0.05, 0).otherwise(5)).when(narrow, F.when(middle < w / 2, 2).otherwise(3)).otherwise(F.when(F.col("y0") < F.col("first"), 1).otherwise(4))
    placed = blocks.join(column_counts(blocks), ["doc", "page"]).withColumn("first", first).withColumn("zone", F.when(F.col("columns") == 2, zone).otherwise(0))
    down = F.when((F.col("columns") == 2) & F.col("zone").isin(0, 5), 0.0).otherwise(F.col("y0"))
    order = Window.partitionBy("doc", "page").orderBy("zone", down, "x0", "block_id")
    return placed.select("doc", "page", "block_id", F.row_number().over(order).cast("bigint").alias("position"))


def margin_roles(blocks: DataFrame) -> DataFrame:
    """blocks with `role`: header for the top twentieth of a page and for texts that repeat there on half of the pages, two at
    least; footer likewise at the bottom, where a text that begins with "page" needn't repeat; else body."""
    top, bottom = F.col("y0") <= F.col("height") * 0.05, F.col("y1") >= F.col("height") * 0.95
    pages = blocks.groupBy("doc").agg(F.greatest(F.lit(2), F.floor((F.countDistinct("page") + 1) / 2)).alias("least"))
    texts = blocks.where(top | bottom).groupBy("doc", "text").agg(F.count_if(top).alias("t"), F.count_if(bottom).alias("b")).join(pages, "doc")
    known = texts.select("doc", "text", (F.col("t") >= F.col("least")).alias("is_header"), ((F.col("b") >= F.col("least")) | ((F.col("b") > 0) & F.lower("text").startswith("page "))).alias("is_footer"))
    role = F.when(F.col("is_header") | top, "header").when(F.col("is_footer") | bottom, "footer").otherwise("body")
    return blocks.join(known, ["doc", "text"], "left").withColumn("role", role).drop("is_header", "is_footer")


def toc_pages(blocks: DataFrame) -> DataFrame:
    """(doc, page) of tables of contents: a title of that name, and two lines that end in a number."""
    text = F.lower(F.trim("text"))
    s = blocks.groupBy("doc", "page").agg(F.max(text.isin(*CONTENTS)).alias("titled"), F.count_if(text.rlike(r"^.{2,}\d\s*$")).alias("entries"))
    return s.where("titled and entries >= 2").select("doc", "page")


def plain_title(text: Column) -> Column:
    """A heading without its number, in lower case, words parted by single spaces."""
    bare = F.regexp_replace(F.trim(text), NUMBER_PREFIX, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}\p{M}_]+", " "))


def heading_parts(text: Column) -> Column:
    """(number, title, level); number is null where there is none."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    pattern = F.when(clean.rlike(APPENDIX), F.lit("a")).when(clean.rlike(NUMBERED), F.lit("n"))
    part = lambda i: F.when(pattern == "a", F.regexp_extract(clean, APPENDIX, i)).when(pattern == "n", F.regexp_extract(clean, NUMBERED, i))
    number = F.upper(part(1))
    title = F.coalesce(F.regexp_replace(part(2), r"^[ .:\-]+|[ .:\-]+$", ""), clean)
    level = F.coalesce(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(1))
    return F.struct(number.alias("number"), title.alias("title"), level.cast("int").alias("level"))


def is_heading(text: Column, font: Column, bold: Column, baseline: Column) -> Column:
    """Short, no caption, no reference to authors, no sentence; with a number or a common title, or set larger or bold."""
    t = F.trim(text)
    title, parts = plain_title(t), heading_parts(t)
    common = title.isin(*COMMON_TITLES)
    barred = (t == "") | (F.length(t) > 160) | title.rlike(r"^(?:figure |fig\. |table )") | t.rlike(r"(?i)^\d+\s+[\p{L}\p{N}\p{M}_]+\s+et\s+al\.") | (t.endswith(".") & ~common)
    seen = (font >= baseline * 1.22) | (bold & (font >= baseline))
    return ~barred & (parts["number"].isNotNull() | common | (seen & (F.size(F.split(parts["title"], r"\s+")) <= 14)))


def section_tree(blocks: DataFrame) -> DataFrame:
    """(doc, ordinal, number, title, plain, level, parent, path, page_start, page_end, direct, below) of each section, from body
    blocks (doc, pos, page, text, font_size, is_bold) in reading order with pos from 0.

    The parent is the nearest heading before of a smaller level; a section goes on until the next heading of its level or a
    smaller one. Both come from running maxima and minima per level, as many as there are levels, without a self-join; paths
    are put together level by level. `direct` counts the blocks up to the next heading, `below` those of all inner sections.
    """
    sizes = blocks.groupBy("doc").agg(F.count("*").alias("blocks"), F.expr("-percentile_disc(0.5) within group (order by -case when font_size > 0 then font_size end)").alias("baseline"))
    told = blocks.join(sizes, "doc").where(is_heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.coalesce("baseline", F.lit(10.0))))
    heads = told.select("doc", "pos", "page", "blocks", F.trim("text").alias("title"), heading_parts(F.col("text")).alias("p"))
    order = Window.partitionBy("doc").orderBy("pos")
    heads = cut(heads.select("doc", "pos", "page", "blocks", "title", "p.number", plain_title(F.col("p.title")).alias("plain"), "p.level", (F.row_number().over(order) - 1).alias("ordinal")))
    levels = range(1, (heads.agg(F.max("level")).first()[0] or 0) + 1)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    at = lambda level, c: F.when(F.col("level") == level, F.col(c))
    rows = heads.select("*", F.lead("pos").over(order).alias("next"), *[F.max(at(k, "ordinal")).over(before).alias(f"b{k}") for k in levels], *[F.min(at(k, "pos")).over(after).alias(f"a{k}") for k in levels], *[F.min(at(k, "ordinal")).over(after).alias(f"o{k}") for k in levels])
    lower = F.array(*[F.when(F.col("level") > k, F.col(f"b{k}")) for k in levels], F.lit(None).cast("int"))
    ends = lambda x: F.array_min(F.array(*[F.when(F.col("level") >= k, F.col(f"{x}{k}")) for k in levels], F.lit(None).cast("int")))
    count = F.max("ordinal").over(Window.partitionBy("doc")) + 1
    rows = cut(rows.select("doc", "ordinal", "pos", "page", "number", "title", "plain", "level", "blocks", "next", F.array_max(lower).alias("parent"), F.coalesce(ends("a"), "blocks").alias("stop"), (F.coalesce(ends("o"), count) - F.col("ordinal") - 1).alias("inner")))
    paths = rows.where("parent is null").select("doc", "ordinal", F.array("title").alias("path"))
    found = paths
    for _ in levels[1:]:
        paths = rows.join(paths.select("doc", F.col("ordinal").alias("parent"), F.col("path").alias("above")), ["doc", "parent"]).select("doc", "ordinal", F.concat("above", F.array("title")).alias("path"))
        found = found.unionByName(paths)
    last = blocks.select("doc", (F.col("pos") + 1).alias("stop"), F.col("page").alias("page_end"))
    direct = F.coalesce("next", "blocks") - F.col("pos") - 1
    joined = rows.join(found, ["doc", "ordinal"]).join(last, ["doc", "stop"], "left")
    below = F.col("stop") - F.col("pos") - 1 - F.col("inner") - direct
    return joined.select("doc", "ordinal", "number", "title", "plain", "level", "parent", "path", F.col("page").alias("page_start"), F.greatest("page", "page_end").alias("page_end"), direct.cast("bigint").alias("direct"), below.cast("bigint").alias("below"))


def attach_sections(artifacts: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, artifact_id, section_id): the last section whose pages hold the artifact's page and that shares a block with it;
    without one the last whose pages hold it; else null. artifacts (doc, artifact_id, page, block_ids), sections (doc,
    section_id, ordinal, page_start, page_end, block_ids). Pages are spread into rows, so the join is on equal keys."""
    spread = sections.select("doc", "section_id", "ordinal", F.col("block_ids").alias("inside"), F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page"))
    met = artifacts.join(spread, ["doc", "page"], "left")
    rank = F.struct(F.coalesce(F.arrays_overlap("block_ids", "inside"), F.lit(False)).alias("shared"), "ordinal")
    return met.groupBy("doc", "artifact_id").agg(F.max_by("section_id", F.when(F.col("section_id").isNotNull(), rank)).alias("section_id"))


def nearest_regions(captions: DataFrame, regions: DataFrame, farthest: float = 90.0) -> DataFrame:
    """(doc, page, caption_id, region_id, distance) of captions that have a region within reach on their page: the vertical gap
    plus .4 of the horizontal one; an algorithm's box that holds its caption comes first, and any box that holds it is in reach.
    Both sides have x0, y0, x1, y1; captions a kind. A page holds a handful of either."""
    c = captions.select("doc", "page", "caption_id", "kind", *[F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])
    both = c.join(regions.select("doc", "page", "region_id", "x0", "y0", "x1", "y1"), ["doc", "page"])
    holds = (F.col("x0") <= F.col("cx0")) & (F.col("y0") <= F.col("cy0")) & (F.col("x1") >= F.col("cx1")) & (F.col("y1") >= F.col("cy1"))
    up = F.least(F.abs(F.col("cy0") - F.col("y1")), F.abs(F.col("y0") - F.col("cy1")))
    side = F.greatest(F.lit(0.0), F.greatest("cx0", "x0") - F.least("cx1", "x1"))
    far = up + side * 0.4 + F.when((F.col("kind") == "algorithm") & holds, -1000.0).otherwise(0.0)
    best = both.groupBy("doc", "page", "caption_id").agg(F.min(F.struct(far.alias("distance"), "region_id", holds.alias("holds"))).alias("b"))
    return best.where((F.col("b.distance") <= farthest) | F.col("b.holds")).select("doc", "page", "caption_id", "b.region_id", "b.distance")


def scrub(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def searchable(path: Column, text: Column) -> Column:
    return F.concat(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " / "), F.lit("\n"), text)


def chunk_rows(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per chunk: its text, first and last page, the box around it, and its blocks in order. A chunk is bounded by the
    packing, so its blocks are gathered whole."""
    inner = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "block_id", "text")))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    rows = blocks.groupBy(*keys).agg(inner.alias("b"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), *box)
    return rows.select(*keys, F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.transform("b", lambda x: x["block_id"]).alias("block_ids"), "page_start", "page_end", "x0", "y0", "x1", "y1")


def with_fallback_section(blocks: DataFrame, sections: DataFrame, name: str = "Document") -> DataFrame:
    """(doc, path, blocks): sections (doc, path, blocks), and one section over all blocks of each document without any."""
    bare = blocks.join(sections.select("doc").distinct(), "doc", "left_anti").groupBy("doc").agg(F.count("*").alias("blocks"))
    return sections.select("doc", "path", "blocks").unionByName(bare.select("doc", F.array(F.lit(name)).alias("path"), "blocks"))


def index_plan(files: DataFrame, indexed: DataFrame, chunks: DataFrame, index_version: int, schema_version: int, fingerprint: Column) -> DataFrame:
    """(file_id, action): reuse where the indexed content, both versions and all chunks are current, each chunk ready and with a
    known section; rebuild where something differs, build where nothing is there. files (file_id, sha256), indexed (file_id,
    sha256, index_version, schema_version), chunks (file_id, ready, fingerprint, section)."""
    sound = chunks.groupBy("file_id").agg(F.bool_and(F.coalesce(F.col("ready") & (F.col("fingerprint") == fingerprint) & (F.col("section") != "unknown"), F.lit(False))).alias("sound"))
    old = indexed.select("file_id", F.col("sha256").alias("old"), "index_version", "schema_version")
    same = (F.col("sha256") == F.col("old")) & (F.col("index_version") == index_version) & (F.col("schema_version") == schema_version) & F.col("sound")
    joined = files.select("file_id", "sha256").join(old, "file_id", "left").join(sound, "file_id", "left")
    return joined.select("file_id", F.when(F.col("old").isNull(), "build").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("rebuild").alias("action"))


def scoped(chunks: DataFrame, files: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Chunks in a scope of files and sections, each a one-column table: null is no filter, an empty table an empty result."""
    for scope, column in ((files, "file_id"), (sections, "section")):
        if scope is not None:
            chunks = chunks.join(scope.select(F.col(scope.columns[0]).alias(column)).distinct(), column, "left_semi")
    return chunks


def parse_quality(pages: DataFrame) -> DataFrame:
    """(doc, score, characters, empty_ratio, warnings) from pages (doc, page, text)."""
    s = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) != "").alias("full"))
    empty = 1 - F.col("full") / F.col("pages")
    score = F.least(F.lit(1.0), F.col("characters") / (F.col("pages") * 100)) * 0.7 + (1 - empty) * 0.3
    warnings = F.array_compact(F.array(F.when(empty > 0, "one_or_more_pages_have_no_extracted_text"), F.when(score < 0.6, "low_text_extraction_quality")))
    return s.select("doc", score.alias("score"), "characters", empty.alias("empty_ratio"), warnings.alias("warnings"))


def choose_reading(pages: DataFrame, readings: DataFrame, least_chars: int = 20, sure: float = 0.55) -> DataFrame:
    """(doc, page, engine): text as it is for pages with enough of it; for others the first engine, by priority, whose mean
    confidence suffices, or the last one. pages (doc, page, text), readings (doc, page, engine, priority, confidence)."""
    means = readings.groupBy("doc", "page", "engine", "priority").agg(F.avg("confidence").alias("mean"))
    best = means.groupBy("doc", "page").agg(F.min_by("engine", F.when(F.col("mean") >= sure, F.col("priority"))).alias("first"), F.max_by("engine", "priority").alias("last"))
    enough = F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars
    return pages.join(best, ["doc", "page"], "left").select("doc", "page", F.when(enough, "text").otherwise(F.coalesce("first", "last", F.lit("none"))).alias("engine"))
