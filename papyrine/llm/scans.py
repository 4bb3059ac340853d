"""Noise in text from scanned pages: found by kind, and repaired into readable paragraphs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.plans.runtime import HOT_ROWS, HOT_SHARE, cut, spread_join
from papyrine.sources.tables import table

#: Marks that scanners leave at a line end, and where a broken word is kept together with its mark.
MARKS = "-‐‑­¬"
JOINT = "\ue000"
#: Misread groups of letters: what is seen, and what may have stood there (fixed values).
CONFUSED = {
    "0": "oO", "1": "liI", "5": "sS", "6": "bG", "9": "gq", "8": "B", "3": "e", "4": "a", "7": "t", "2": "z",
    "@": "a", "!": "il", "|": "li", "$": "s", "†": "t", "¢": "c", "€": "e", "£": "e", "í": "i", "ì": "i", "é": "e", "ó": "o", "á": "a", "ú": "u",
    "c": "e", "b": "h", "h": "b", "e": "c",
}
CONFUSED_GROUPS = {
    "rn": ["m"], "m": ["rn", "in", "ni"], "vv": ["w"], "w": ["vv"], "cl": ["d"], "d": ["cl"], "ri": ["n"], "ii": ["u", "n"], "li": ["h"],
    "lr": ["k"], "nn": ["m"], "tl": ["d"], "ln": ["h"], "in": ["m"], "ni": ["m"], "h": ["li"], "n": ["ri"], "fi": ["ﬁ"], "ﬁ": ["fi"], "ﬂ": ["fl"], "ﬀ": ["ff"], "iii": ["m"], "lc": ["k"], "il": ["u"],
}
#: Edits that a misread word may be away from its true form.
EDITS = 2
#: A word is a repair for another only if it is so many times as frequent.
RATIO = 8
#: Both halves of a word at a line end are words of their own if they stand so many times as often as the broken one.
HALVES = 4
#: Keys of suspects and of vocabulary that one block of the search holds, about.
BLOCK_KEYS = 200_000
#: Running text that repeats counts as a header only in so many of its file's chunks, and in this share of them.
RUNNING_CHUNKS, RUNNING_SHARE = 3, 0.5

_NUMBER = regex.compile(r"^[\s\-–—\[(|·.]*(?:(page|p\.|pp\.|seite|第)\s*)?(\d{1,5}|[ivxlcdmIVXLCDM]{1,8})(?:\s*(?:of|/)\s*\d{1,5})?\s*(页)?[\s\-–—\])|·.]*$", regex.IGNORECASE)
_EDGE_NUMBER = regex.compile(r"^\s*(\d{1,5})\s+(?=\S)|(?<=\S)\s+(\d{1,5})\s*$")
_TABLE_ROW = regex.compile(r"^\S.*\s-?\d+(?:\.\d+)?%?$|^\d+(?:\.\d+)?$|^table\s+\d+", regex.IGNORECASE)
_BROKEN = regex.compile(rf"([^\W\d_][\w'’@!†¢$|-]*|[\w@!†¢$|]*[^\W\d_])[{MARKS}][ \t]*$")
_MARK_SET = frozenset(MARKS)
_GOES_ON = regex.compile(r"^[ \t]*([\w@!†¢$|][\w@!†¢$|'’-]*)")


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total, low = 0, text.lower()
    if not low or any(c not in values for c in low):
        return None
    for a, b in zip(low, low[1:] + " ", strict=True):
        total += -values[a] if values.get(b, 0) > values[a] else values[a]
    return total


def page_number(line: str, first: int | None, last: int | None, near_table: bool) -> bool:
    """Whether a line is nothing but the number of one of the chunk's pages. A bare number must name such a page, and
    inside a table's rows, where it could be a value, the first or last of them; without a known page only a number
    that is dressed as a page's counts."""
    if len(line) > 40 or not line.strip():
        return False
    m = _NUMBER.match(line)
    if not m:
        return False
    if m.group(1) and m.group(1).startswith("第") and not m.group(3):
        return False
    value = int(m.group(2)) if m.group(2).isdigit() else roman(m.group(2))
    dressed = bool(m.group(1) or m.group(3)) or bool(regex.match(r"^\s*[\[\-–—(|]", line)) or " of " in line.lower()
    lo, hi = (first if first is not None else last), (last if last is not None else first)
    if lo is None:
        return dressed
    if first is None:
        lo -= 1
    if line.rstrip().endswith((".", "。")) and not dressed:
        return False
    return value is not None and lo <= value <= hi and not near_table


#: Letters that a misreading turns into one another, and one letter for all of them (fixed values).
_SAME = {"0": "o", "1": "l", "i": "l", "!": "l", "í": "l", "|": "l", "5": "s", "$": "s", "6": "h", "b": "h", "9": "g", "@": "a", "†": "t", "7": "t", "¢": "e", "c": "e", "u": "h"}
_SAME_GROUPS = (("rn", "m"), ("vv", "w"), ("el", "d"), ("ll", "h"), ("rl", "n"))
#: What is no header: a page number alone, a caption, a row of a table, a bracket or a mark of Han text, the end of a sentence.
_NO_HEADER = (
    r"(?i)^[\s\-–—\[(|·.]*(?:(?:page|p\.|pp\.|seite|第)\s*)?(?:\d{1,5}|[ivxlcdm]{1,8})(?:\s*(?:of|/)\s*\d{1,5})?\s*页?[\s\-–—\])|·.]*$"
    r"|^\s*(?:table|fig(?:ure)?\.?|图|表)\s*\d+\b|^\S.*\s-?\d+\.\d+%?\s*$|[(，。；]|(?<!\ba[l1I!|])[.!?,;:]\s*$"
)
_RUNNING = r"(?<![\p{L}\d_\-@†¢!])\p{Ll}[\p{L}\d_\-@†¢!]{3,}"


def header_key(line: Column) -> Column:
    """A running header's identity: letters alone, without a page number at its edge, and with letters that are misread
    for one another made one. Null for what is no header's form."""
    letters = F.translate(F.lower(F.regexp_replace(line, r"^\s*\d{1,5}\s+(?=\S)|(?<=\S)\s+\d{1,5}\s*$", " ")), "".join(_SAME), "".join(_SAME.values()))
    for seen, one in _SAME_GROUPS:
        letters = F.replace(letters, F.lit(seen), F.lit(one))
    letters = F.regexp_replace(letters, r"[^\p{L}]+", "")
    return F.when(~line.rlike(_NO_HEADER) & (F.length(letters) >= 4), letters)


def headers(chunks: DataFrame) -> DataFrame:
    """(chunk_id, idx) of the lines that repeat their file's running header, wherever in a chunk they stand; in Han text, which
    doesn't show by its form what is running text, where a page can begin: at the chunk's top, or in one that runs over a page.

    A header's key stands in two or more chunks of its file. Lines of running text, which hold a longer word in lower case,
    must stand in RUNNING_SHARE of them, since sentences repeat too. The title of one of the file's own sections is no header,
    nor is a key that is a section's title in more files than it repeats in. Counts by file and key are combined map-side, so
    that a file with a large part of all chunks is no single task; files, however many share a header, are judged each alone.
    """
    text = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    over = F.coalesce(F.col("page_end") > F.col("page_start"), F.col("page_start").isNull(), F.lit(False))
    lines = chunks.where("text is not null and file_id is not null").select("file_id", "chunk_id", over.alias("over"), F.posexplode(text).alias("idx", "line"))
    edge = (F.col("idx") <= 2) | F.col("over") | ~F.col("line").rlike(r"\p{IsHan}")
    keyed = cut(lines.where((F.length("line") >= 4) & edge).select("file_id", "chunk_id", "idx", header_key(F.col("line")).alias("key"), F.col("line").rlike(_RUNNING).alias("running")).where("key is not null"))
    sizes = chunks.where("file_id is not null").groupBy("file_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    per = keyed.groupBy("file_id", "key", "chunk_id").agg(F.bool_and("running").alias("running")).groupBy("file_id", "key").agg(F.count("*").alias("n"), F.bool_and("running").alias("running")).where("n >= 2")
    often = (F.col("n") >= RUNNING_CHUNKS) & (F.col("n") >= F.col("chunks") * RUNNING_SHARE)
    per = cut(per.join(sizes, "file_id").where(~F.col("running") | often).select("file_id", "key"))
    title = header_key(F.regexp_replace("t", r"^[\dA-Z]+(?:\.\d+)*\.?\s+", ""))
    titles = cut(chunks.where("file_id is not null").select("file_id", F.explode("section_path").alias("t")).select("file_id", title.alias("key")).where("key is not null").distinct().join(per.select("key").distinct(), "key", "left_semi"))
    headings = titles.groupBy("key").agg(F.count("*").alias("as_title")).join(per.groupBy("key").agg(F.count("*").alias("as_header")), "key").where("as_title > as_header").select("key")
    own = per.join(titles, ["file_id", "key"], "left_anti").join(headings, "key", "left_anti")
    return spread_semi(keyed, own)


def spread_semi(keyed: DataFrame, own: DataFrame) -> DataFrame:
    """(chunk_id, idx) of the lines with a header's key; a header that a large file repeats is no single task."""
    named = lambda df: df.withColumn("place", F.struct("file_id", "key"))
    return spread_join(named(keyed).select("place", "chunk_id", "idx"), named(own).select("place"), "place").select("chunk_id", "idx")


_ROW = regex.compile(r"^\S.*[^.\d]\s-?\d+(?:\.\d+)?%?$")


def _among_rows(lines: list[str], i: int, first: int | None, last: int | None) -> bool:
    """Whether the bare number in line i stands among a table's rows: next to one, and neither at the chunk's edge with
    one of its own page numbers."""
    rows = [len(lines[j]) < 60 and bool(_ROW.match(lines[j])) for j in (i - 1, i + 1) if 0 <= j < len(lines)]
    edge = i in (0, len(lines) - 1) and int(lines[i]) in (first, last)
    return any(rows) and (all(rows) or not edge) and (first is None or int(lines[i]) != first or 0 < i < len(lines) - 1)


def strip_furniture(text: str, header_lines: set[int], first: int | None, last: int | None) -> tuple[str, bool, bool]:
    """(body, header, page_number): the text without headers and page numbers; words broken at a line end keep their
    mark as JOINT + mark + JOINT and stand in one line."""
    lines = regex.sub(r"\r\n?", "\n", text.replace(JOINT, "")).split("\n")
    kept: list[str] = []
    header = number = False
    for i, line in enumerate(lines):
        if i in header_lines:
            header = True
            edge = _EDGE_NUMBER.search(line)
            value = int(edge.group(1) or edge.group(2)) if edge else None
            lo, hi = (first if first is not None else last), (last if last is not None else first)
            if value is not None and (lo is None or lo - 1 <= value <= hi + 1):
                # a journal's volume also stands at the edge; a page number names one of the chunk's pages
                number = number or (not regex.search(r"\bvol\.?\s*\d+\s*$", line, regex.IGNORECASE) and lo is not None and lo <= value <= hi)
            continue
        if page_number(line, first, last, line.strip().isdigit() and _among_rows(lines, i, first, last)):
            number = True
            continue
        kept.append(line)
    body: list[str] = []
    for line in kept:
        if body and body[-1].rstrip(" \t")[-1:] in _MARK_SET and (m := _BROKEN.search(body[-1])) and (g := _GOES_ON.match(line)):
            mark = body[-1][m.end(1)]
            body[-1] = body[-1][: m.end(1)] + JOINT + mark + JOINT + line[g.start(1) :]
        else:
            body.append(line)
    return "\n".join(body), header, number


def bodies(chunks: DataFrame) -> DataFrame:
    """(chunk_id, body, header, page_number) of each distinct chunk with a text."""
    found = headers(chunks).groupBy("chunk_id").agg(F.collect_set("idx").alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                page = lambda x: None if x is None or x != x else int(x)
                rows.append((r.chunk_id, *strip_furniture(r.text, set() if r.lines is None else {int(x) for x in r.lines}, page(r.page_start), page(r.page_end))))
            yield pd.DataFrame(rows, columns=["chunk_id", "body", "header", "page_number"])

    joined = chunks.where("text is not null and chunk_id is not null").select("chunk_id", "text", "page_start", "page_end").join(found, "chunk_id", "left")
    return joined.mapInPandas(run, "chunk_id string, body string, header boolean, page_number boolean")


def tokens_of(body: DataFrame) -> DataFrame:
    """(chunk_id, pos, token) of the Latin words of each body, without the punctuation around them."""
    words = F.split(F.regexp_replace("body", r"[\p{IsHan}，。；：！？、（）《》“”「」]+", " "), r"[\s/]+")
    bare = F.regexp_replace("word", r"^[(\[\"'‘“]+|[.,;:?!)\]\"'’”%]+$", "")
    rows = body.select("chunk_id", F.posexplode(words).alias("pos", "word")).select("chunk_id", "pos", bare.alias("token"))
    return rows.where((F.length("token") >= 2) & F.col("token").rlike(r"\p{L}"))


def _joint(n: int) -> Column:
    return F.split("token", JOINT)[n]


def broken_words(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, whole, broken): whether the mark at a line end broke a word, or is the compound's own.

    The joined word and the compound are looked up among the words that stand unbroken elsewhere. Marks other than
    the plain hyphen are no letter of any word. Where neither form is known, a part that begins with a capital or
    digit, or two parts that are words themselves, make a compound.
    """
    split = tokens.where(F.col("token").contains(JOINT)).groupBy("token").agg(F.count("*").alias("times"))
    parts = split.select("token", "times", _joint(0).alias("l"), _joint(1).alias("mark"), _joint(2).alias("r"))
    forms = parts.select("token", "times", "l", "mark", "r", F.concat("l", "r").alias("whole"), F.concat("l", F.lit("-"), "r").alias("own"), F.element_at(F.split("l", "-"), -1).alias("ll"), F.element_at(F.split("r", "-"), 1).alias("rr"))
    look = counts.select(F.col("word").alias("w"), "n")
    wanted = forms.select("token", F.explode(F.create_map(F.lit("whole"), F.lower("whole"), F.lit("own"), F.lower("own"), F.lit("ll"), F.lower("ll"), F.lit("rr"), F.lower("rr"))).alias("form", "w"))
    found = wanted.join(look, "w", "left").groupBy("token").pivot("form", ["whole", "own", "ll", "rr"]).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    known = forms.select("token", "times", "mark", "r", F.col("whole").alias("joined"), F.col("own").alias("compound")).join(found, "token")
    plain = F.col("mark") == "-"
    compound = plain & ((F.col("own") > F.col("whole")) | ((F.col("own") == F.col("whole")) & (F.col("r").rlike(r"^[\p{Lu}\d]") | (F.least("ll", "rr") >= F.col("times") * HALVES))))
    return known.select("token", F.when(compound, F.col("compound")).otherwise(F.col("joined")).alias("whole"), (~compound).alias("broken"))


class Trie:
    """A vocabulary trie, and the words of it that a Levenshtein automaton of a word accepts."""

    def __init__(self, words: Sequence[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, edits: int) -> list[tuple[str, int]]:
        """Every word of the trie at most so many edits away, with its distance. The automaton's states are the sets
        of (position, errors) that are still alive; it is run along the trie, so a common prefix is read once and a
        branch is left where no state is alive."""
        n, found = len(word), []

        def close(states: dict[int, int]) -> dict[int, int]:
            for i in sorted(states):
                e = states[i]
                j = i
                while j < n and e < edits:
                    j, e = j + 1, e + 1
                    if states.get(j, edits + 1) <= e:
                        break
                    states[j] = e
            return states

        stack = [(self.root, close({0: 0}))]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    if n in states:
                        found.append((child, states[n]))
                    continue
                nxt: dict[int, int] = {}
                for i, e in states.items():
                    if i < n and word[i] == c and e < nxt.get(i + 1, edits + 1):
                        nxt[i + 1] = e
                    if e < edits:
                        if e + 1 < nxt.get(i, edits + 1):
                            nxt[i] = e + 1
                        if i < n and e + 1 < nxt.get(i + 1, edits + 1):
                            nxt[i + 1] = e + 1
                if nxt:
                    stack.append((child, close(nxt)))
        return found


def misreading_cost(seen: str, true: str) -> float | None:
    """The number of misread groups that turn true into seen, or null where other changes are needed too. One reading
    costs 1, a symbol or digit inside letters half as much."""
    best = {(0, 0): 0.0}
    for i in range(len(seen) + 1):
        for j in range(len(true) + 1):
            if (i, j) not in best:
                continue
            cost = best[i, j]

            def step(a: int, b: int, more: float, i: int = i, j: int = j, cost: float = cost) -> None:
                if cost + more < best.get((i + a, j + b), math.inf):
                    best[i + a, j + b] = cost + more

            if i < len(seen) and j < len(true):
                if seen[i] == true[j]:
                    step(1, 1, 0)
                elif true[j] in CONFUSED.get(seen[i], ""):
                    step(1, 1, 1.0 if seen[i].isascii() and seen[i].isalpha() else 0.5)
            for k in (1, 2, 3):
                for t in CONFUSED_GROUPS.get(seen[i : i + k], ()) if i + k <= len(seen) else ():
                    if true.startswith(t, j):
                        step(k, len(t), 0.5 if not seen[i].isascii() else 1.0)
    return best.get((len(seen), len(true)))


def vocabulary_keys(word: str) -> list[str]:
    """The three segments of a word, each with its number and the word's length: whatever is within EDITS of the word holds one
    of them unchanged."""
    m = len(word)
    ends = (0, m // 3, m // 3 + (m + 1) // 3, m)
    return [f"{i} {m} {word[ends[i] : ends[i + 1]]}" for i in range(3)]


def suspect_keys(word: str) -> set[str]:
    """The keys of every vocabulary word within EDITS of this one, among others: for each length such a word can have, the
    stretches of this one that its segments can stand at. Left of segment i there are at most i edits if it is the first that
    is unchanged on that count, and right of it EDITS - i."""
    n, keys = len(word), set()
    for m in range(max(3, n - EDITS), n + EDITS + 1):
        ends, shift = (0, m // 3, m // 3 + (m + 1) // 3, m), n - m
        for i in range(3):
            size = ends[i + 1] - ends[i]
            first, last = max(ends[i] - i, ends[i] + shift - (EDITS - i), 0), min(ends[i] + i, ends[i] + shift + (EDITS - i), n - size)
            keys.update(f"{i} {m} {word[at : at + size]}" for at in range(first, last + 1))
    return keys


def repairs(counts: DataFrame) -> DataFrame:
    """(word, true, cost, n): for words (word, n) all true forms that are RATIO times as frequent and explain it by
    misreading.

    Suspects and vocabulary meet where they share a segment that an edit can't have touched in all three places at once; in
    each such bucket the suspects' automata are intersected with the trie of the bucket's words. Work follows the candidates,
    not the product of both; blocks of buckets follow the number of keys, nothing is sent to the driver but that number, and
    no candidate is lost.
    """
    vocabulary = counts.where((F.col("n") >= RATIO) & F.col("word").rlike(r"^[\p{L}][\p{L}'’\-]+$") & (F.length("word") >= 3))
    suspects = counts.where((F.length("word") >= 3) & ~F.col("word").rlike(r"^(?:\d.{0,2}|\d+(?:st|nd|rd|th))$"))
    blocks = max(24, math.ceil(counts.count() * 20 / BLOCK_KEYS))
    # little data and much work: a fixed number of partitions, which adaptive execution doesn't merge
    tasks = min(blocks, 4 * max(8, counts.sparkSession.sparkContext.defaultParallelism))

    def keyed(words: DataFrame, keys_of: Callable[[str], Iterable[str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(xxhash.xxh32_intdigest(k) % blocks, k, w, n) for w, n in zip(pdf["word"], pdf["n"], strict=True) for k in keys_of(w)]
                yield pd.DataFrame(rows, columns=["block", "key", "word", "n"])

        return words.repartition(tasks, "word").mapInPandas(run, "block int, key string, word string, n bigint").repartition(tasks, "block")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        frequency = dict(zip(b["word"], b["n"], strict=True))
        buckets = {k: list(x) for k, x in b.groupby("key")["word"]}
        tries: dict[str, Trie] = {}
        rows: dict[tuple[str, str], tuple[float, int]] = {}
        for key, word, n in zip(a["key"], a["word"], a["n"], strict=True):
            if key not in buckets:
                continue
            if key not in tries:
                tries[key] = Trie(buckets[key])
            for true, distance in tries[key].within(word, EDITS):
                if distance and frequency[true] >= RATIO * n and (word, true) not in rows:
                    cost = misreading_cost(word, true)
                    if cost is not None and cost <= EDITS:
                        rows[word, true] = (cost, int(frequency[true]))
        return pd.DataFrame([(w, t, c, n) for (w, t), (c, n) in rows.items()], columns=["word", "true", "cost", "n"])

    left, right = keyed(suspects, suspect_keys), keyed(vocabulary, vocabulary_keys)
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(search, "word string, true string, cost double, n bigint").distinct()


def noise(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bodies, words, fixes): each chunk's body; its words (chunk_id, pos, token, whole, broken); and the misread ones
    (chunk_id, pos, token, true), ranked by what was misread, by the word before, and by frequency."""
    body = cut(bodies(chunks))
    tokens = cut(tokens_of(body))
    counts = cut(tokens.where(~F.col("token").contains(JOINT)).groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")))
    joints = cut(broken_words(tokens, counts))
    split = F.col("token").contains(JOINT)
    words = tokens.where(~split).select("chunk_id", "pos", "token", F.col("token").alias("whole"), F.lit(False).alias("broken"))
    words = cut(words.unionByName(tokens.where(split).join(joints, "token").select("chunk_id", "pos", "token", "whole", "broken")))
    every = cut(words.groupBy(F.lower("whole").alias("word")).agg(F.count("*").alias("n")))
    found = cut(repairs(every).groupBy("word").agg(F.collect_list(F.struct("true", "cost", "n")).alias("forms")))
    total = every.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in every.where(F.col("n") > max(HOT_ROWS, total * HOT_SHARE)).select("word").collect()]  # at most 1 / HOT_SHARE
    before = F.lower(F.lag("whole").over(Window.partitionBy("chunk_id").orderBy("pos")))
    placed = words.withColumn("before", before).withColumn("word", F.lower("whole"))
    fragment = (F.length("whole") < 5) & F.col("whole").rlike(r"^\p{Lu}\p{L}+$")  # of a name, cut by a line's end
    misread = spread_join(placed.where(~fragment), found, "word", hot=hot).select("chunk_id", "pos", "token", "whole", "before", F.inline("forms"))
    pairs = placed.where("before is not null").groupBy("before", F.col("word").alias("true")).agg(F.count("*").alias("together"))
    ranked = misread.join(pairs, ["before", "true"], "left").groupBy("chunk_id", "pos", "token", "whole").agg(F.min_by("true", F.struct("cost", -F.coalesce("together", F.lit(0)), -F.col("n"), "true")).alias("true"))
    return body, words, ranked


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by key, exact duplicates once; of rows that share a key the one whose text comes first, then file, section and pages."""
    row = F.min(F.struct(F.col("text").isNull().alias("none"), "text", "file_id", "section_path", "page_start", "page_end")).alias("r")
    return table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(row).select("chunk_id", "r.file_id", "r.text", "r.section_path", "r.page_start", "r.page_end")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk and kind of noise. A chunk without a key, or with a null or empty text, is in no row; one
    without a file has no header; without pages, only a number dressed as a page's counts. Repeated rows count once,
    an empty table gives no rows, and columns beyond those named are ignored."""
    body, words, fixes = noise(cut(chunk_texts(spark, sf_dir)))
    kinds = [
        words.where("broken").select("chunk_id", F.lit("hyphen").alias("noise_kind")),
        fixes.select("chunk_id", F.lit("chars").alias("noise_kind")),
        body.where("header").select("chunk_id", F.lit("header").alias("noise_kind")),
        body.where("page_number").select("chunk_id", F.lit("page_number").alias("noise_kind")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]).distinct()


def _like(seen: str, true: str) -> str:
    """The true word in the capitals of the seen one."""
    return true.upper() if seen.isupper() and len(seen) > 2 else true[:1].upper() + true[1:] if seen[:1].isupper() else true


def reflow(body: str, whole: dict[str, str], true: dict[str, str]) -> str:
    """Readable paragraphs: broken and misread words put right, lines of a paragraph joined, blank lines kept between
    paragraphs; headings and table rows stay lines of their own. Han lines are joined without a space."""
    body = regex.sub(rf"[^\s/()]*{JOINT}[^\s/()]*", lambda m: _swap(m.group(), whole), body)
    if true:
        body = regex.sub(r"\S+", lambda m: _swap(m.group(), true), body)
    paragraphs = []
    for block in regex.split(r"\n[^\S\n]*\n\s*", body):
        out = ""
        for line in block.split("\n"):
            line = line.strip()
            if not line:
                continue
            alone = bool(_TABLE_ROW.match(line)) and len(line) < 60
            tight = out and regex.search(r"\p{Han}$|[，。；：、！？]$", out) and regex.match(r"\p{Han}|[，。；：、！？]", line)
            out = line if not out else out + ("\n" if alone else "" if tight else " ") + line
        if out:
            paragraphs.append(out)
    return "\n\n".join(paragraphs)


def _swap(word: str, table_: dict[str, str]) -> str:
    bare = regex.sub(r"^[(\[\"'‘“]+|[.,;:?!)\]\"'’”%]+$", "", word)
    return word.replace(bare, table_[bare]) if bare in table_ else word.replace(JOINT, "") if JOINT in word else word


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text, repairs): every chunk with its text made readable; null text stays null."""
    chunks = cut(chunk_texts(spark, sf_dir))
    body, words, fixes = noise(chunks)
    joins = words.where(F.col("token").contains(JOINT)).groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "whole"))).alias("whole"))
    trues = fixes.groupBy("chunk_id", "whole").agg(F.min("true").alias("true")).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("whole", "true"))).alias("true"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.body is None:
                    rows.append((r.chunk_id, None, 0))
                    continue
                whole, true = dict(r.whole or {}), dict(r.true or {})
                rows.append((r.chunk_id, reflow(r.body, whole, {k: _like(k, v) for k, v in true.items()}), len(whole) + len(true) + int(r.header) + int(r.page_number)))
            yield pd.DataFrame(rows, columns=["chunk_id", "text", "repairs"])

    joined = chunks.select("chunk_id").join(body, "chunk_id", "left").join(joins, "chunk_id", "left").join(trues, "chunk_id", "left")
    joined = joined.withColumns({"header": F.coalesce("header", F.lit(False)), "page_number": F.coalesce("page_number", F.lit(False))})
    return joined.mapInPandas(run, "chunk_id string, text string, repairs int")


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
