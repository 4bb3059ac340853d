"""Oversized texts into pieces at natural boundaries, all cuts at once by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import table

LIMIT, OVERLAP = 700, 80
KINDS = ("paragraph", "sentence", "word")
#: Where a cut may stand: the end of each match.
_CUTS = {
    "paragraph": regex.compile(r"\n[^\S\n]*\n\s*"),
    "sentence": regex.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*"),
    "word": regex.compile(r"\s+"),
}


def boundaries(text: str) -> dict[str, np.ndarray]:
    """Positions of the cuts of each kind, inside the text, ascending; each kind holds those of the coarser ones."""
    found: dict[str, np.ndarray] = {}
    sofar: set[int] = set()
    for kind in KINDS:
        sofar |= {m.end() for m in _CUTS[kind].finditer(text)}
        found[kind] = np.array(sorted(p for p in sofar if 0 < p < len(text)), dtype=np.int64)
    return found


def squared_end(table_: np.ndarray) -> int:
    """Where the chain from 0 ends, by squaring the table of successors until it no longer changes."""
    while True:
        twice = table_[table_]
        if np.array_equal(twice, table_):
            return int(table_[0])
        table_ = twice


def successors(text: str, edges: np.ndarray, solid: np.ndarray, limit: int) -> np.ndarray:
    """For each boundary, by its number, the number of the farthest one so that the text between them, bare of the white space
    around it, is within the limit; the boundary itself where even the next one is too far. `solid` holds the places that are
    no white space."""
    first = np.searchsorted(solid, edges)
    start = solid[np.minimum(first, len(solid) - 1)] if len(solid) else edges
    last = np.searchsorted(solid, start + limit)  # the first solid place beyond what a piece from here can hold
    beyond = solid[np.minimum(last, len(solid) - 1)] if len(solid) else edges
    reach = np.where(last < len(solid), np.searchsorted(edges, beyond, side="right") - 1, len(edges) - 1)
    return np.maximum(reach, np.arange(len(edges)))


def coarsest(text: str, limit: int, cuts: dict[str, np.ndarray] | None = None) -> str:
    """The coarsest kind of boundary that alone cuts the text into pieces within the limit: the chain of farthest successors,
    without overlap, leads from the text's beginning to its end. A part above the limit stops every chain before it."""
    cuts = boundaries(text) if cuts is None else cuts
    solid = np.flatnonzero(~np.array([c.isspace() for c in text], dtype=bool))
    for kind in KINDS:
        edges = np.concatenate([[0], cuts[kind], [len(text)]])
        if squared_end(successors(text, edges, solid, limit)) == len(edges) - 1:
            return kind
    return "none"


def longest_part(text: str, edges: np.ndarray) -> int:
    """The longest part between neighbouring boundaries, bare of white space: an exact check of `coarsest`."""
    return max((len(text[a:b].strip()) for a, b in zip(edges[:-1], edges[1:], strict=True)), default=0)


def cut_ends(text: str, limit: int, overlap: int, cuts: dict[str, np.ndarray]) -> np.ndarray:
    """Ends of the pieces of a greedy cut, in order.

    The successor of an end e is the farthest legal end of a piece that begins at e - overlap: the last boundary of
    the coarsest kind after e and within the limit, or the limit itself where there is none. The table of all
    successors comes from one sorted search per kind; the chain from the first end is then gathered by squaring
    the table, so that the number of steps is logarithmic in the number of pieces.
    """
    n = len(text)
    ends = np.arange(n + 1, dtype=np.int64)
    start = np.maximum(ends - overlap, 0)
    start[0] = 0
    reach = np.minimum(start + limit, n)
    nxt = reach.copy()
    open_ = reach < n
    for kind in KINDS:
        at = np.searchsorted(cuts[kind], reach, side="right") - 1
        best = np.where(at >= 0, cuts[kind][np.maximum(at, 0)] if len(cuts[kind]) else 0, 0)
        take = open_ & (best > ends) & (best - start > overlap)
        nxt[take] = best[take]
        open_ &= ~take
    chain, table_ = np.array([nxt[0]]), nxt
    while chain[-1] < n:
        chain = np.concatenate([chain, table_[chain]])
        keep = np.concatenate([[True], chain[1:] > chain[:-1]])
        chain = chain[: len(chain) if keep.all() else int(np.argmin(keep))]
        table_ = table_[table_]
    return chain


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; a text within the limit is one piece, an empty one none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends = cut_ends(text, limit, overlap, boundaries(text))
    starts = np.concatenate([[0], np.maximum(ends[:-1] - overlap, 0)])
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks above the limit, exact duplicates once; of rows that share key and text, the one whose page and then section come
    first. Null and shorter texts have nothing to cut."""
    chunks = table(spark, sf_dir, "chunks").where(F.length("text") > LIMIT)
    place = F.min(F.struct("page_start", "section_path")).alias("p")
    return chunks.groupBy("chunk_id", "text").agg(place).select("chunk_id", "text", "p.section_path", "p.page_start")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, boundary) of the oversized chunks, from the successor tables of each kind of boundary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "boundary": [coarsest(t, LIMIT) for t in pdf["text"]]})

    return oversized(spark, sf_dir).select("chunk_id", "text").mapInPandas(run, "chunk_id string, boundary string")


def cut_pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start, piece) of every text: pieces of at most `limit` characters, each beginning `overlap`
    characters before the last one's end. A null or empty text has no piece; repeated rows repeat their pieces;
    other columns are ignored. No shuffle: texts are cut where they are read, a batch at a time."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, t[a:b]) for k, t in zip(pdf["k"], pdf["t"], strict=True) for i, (a, b) in enumerate(split_text(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["k", "piece_no", "start", "piece"])

    source = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInPandas(run, f"k {kind}, piece_no int, start int, piece string").withColumnRenamed("k", key)


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversized chunks, each with its section_path and page_start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.chunk_id, i, a, r.text[a:b], r.section_path, r.page_start) for r in pdf.itertuples() for i, (a, b) in enumerate(split_text(r.text))]
            out = pd.DataFrame(rows, columns=["chunk_id", "piece_no", "start", "piece", "section_path", "page_start"])
            yield out.assign(page_start=out["page_start"].astype("Int32"))

    return oversized(spark, sf_dir).mapInPandas(run, "chunk_id string, piece_no int, start int, piece string, section_path array<string>, page_start int")


_BLANK = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = "list_filter(list_transform(range(1, len({0})), lambda i: length(array_to_string({0}[1:i], ''))), lambda p: p > 0 and p < length(text))"
#: The greedy cuts one after another, from the boundaries of each kind as lists of places.
_PIECES = rf"""
with recursive big as (select chunk_id, text, min({{'p': page_start, 's': section_path}}) as place from chunks where length(text) > 700 group by chunk_id, text),
split as (
  select *, string_split(regexp_replace(text, '(\n{_BLANK.replace(chr(92) + "n", "", 1)}*\n{_BLANK}*)', '\1<<|>>', 'g'), '<<|>>') as ps,
    string_split(regexp_replace(text, '([.!?]{_BLANK}+|[。！？]{_BLANK}*)', '\1<<|>>', 'g'), '<<|>>') as ss,
    string_split(regexp_replace(text, '({_BLANK}+)', '\1<<|>>', 'g'), '<<|>>') as ws from big),
places as (select chunk_id, text, place, {_ENDS.format("ps")} as p, {_ENDS.format("ss")} as s, {_ENDS.format("ws")} as w from split),
kinds as (select chunk_id, text, place, p, list_distinct(list_concat(p, s)) as s, list_distinct(list_concat(p, s, w)) as w from places),
walk(chunk_id, text, place, p, s, w, piece_no, a, b, reach) as (
  select chunk_id, text, place, p, s, w, -1, 0, 0, 0 from kinds
  union all
  select chunk_id, text, place, p, s, w, piece_no + 1, start, case when top >= length(text) then length(text) else coalesce(
    list_max(list_filter(p, lambda x: x > b and x <= top and x - start > 80)), list_max(list_filter(s, lambda x: x > b and x <= top and x - start > 80)),
    list_max(list_filter(w, lambda x: x > b and x <= top and x - start > 80)), top) end, top
  from (select *, greatest(b - 80, 0) as start, greatest(b - 80, 0) + 700 as top from walk where b < length(text)) step)
select chunk_id, cast(piece_no as int) as piece_no, cast(a as int) as start, substring(text, a + 1, b - a) as piece, place.s as section_path, place.p as page_start from walk where piece_no >= 0
"""

QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
SQL = {
    "p7_found": r"""
with big as (select distinct chunk_id, text from chunks where length(text) > 700),
marked as (
  select *, regexp_replace(text, '\n[\t\f\v\r \x{00a0}\x{2000}-\x{200a}\x{3000}]*\n\s*', '<<|>>', 'g') as p from big),
cuts as (
  select chunk_id, p, regexp_replace(regexp_replace(p, '([.!?])\s+', '\1<<|>>', 'g'), '([。！？])\s*', '\1<<|>>', 'g') as s from marked),
parts as (
  select chunk_id,
    list_max(list_transform(string_split(p, '<<|>>'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))) as p,
    list_max(list_transform(string_split(s, '<<|>>'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))) as s,
    list_max(list_transform(regexp_split_to_array(replace(s, '<<|>>', ' '), '\s+'), lambda x: length(x))) as w
  from cuts)
select chunk_id, case when p <= 700 then 'paragraph' when s <= 700 then 'sentence' when w <= 700 then 'word' else 'none' end as boundary
from parts
""",
    "p7_pieces": _PIECES,
}
