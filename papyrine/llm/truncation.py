"""Texts cut off by field limits or broken transfers."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.plans.runtime import cut, spread_join
from papyrine.sources.tables import table

# Patterns for the end of a text are matched from there backwards, so they cost what they match and see as far as it goes.
#: A closing mark, perhaps with quotes, brackets or citations after it.
_CLOSED = regex.compile(r"(?r)[.!?。！？][\"'”’」』）)\]*_`]*(?:\s*\[[^\[\]\n]{1,12}\])*\s*")
#: What a field limit writes over the end.
_MARK = regex.compile(r"(?r)(?:\s*(?:…|\.\.\.+|\[(?:truncated|cut|snip|more|\.\.\.|…)\]|\((?:truncated|continued|cont\.|more)\)|<truncated>|\[&hellip;\]|&hellip;|>>|-->))\s*", regex.IGNORECASE)
#: Notes set after a whole text: they are no part of its last sentence.
_NOTE = regex.compile(r"(?r)\s*(?:\[see [^\]\n]{1,40}\]|\((?:translated|reprinted|adapted|abridged)[^()\n]{1,60}\)|\bEnd of (?:excerpt|document|text|section|abstract)\.?)\s*", regex.IGNORECASE)
_SENTENCE = re.compile(r"[.!?][\"'”’)\]]?\s+(?=[^\Wa-z_]|[\[*\"“(-])|[。！？]\s*")
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{N}][\p{L}\p{N}\p{M}'’.\-<>=/]*[\p{L}\p{N}\p{M}]|[\p{L}\p{N}]|[^\s\p{L}\p{N}]")
#: Words of closed classes; every other word of a sentence is shown by its kind alone (fixed values).
CLOSED_CLASS = frozenset(
    "a an the this these that those our its their his her we it they i he she you who which whose what and or nor but neither either both than "
    "of in on for from to with without by at as under over after before between through against above below into outside inside within about "
    "is are was were be been being has have had do does did can cannot could may might must shall should will would not only if when whenever "
    "while although though because since unless until so despite unlike following there here even then later again next least every each no any "
    "some all most more less such same other extra also et al cf sec fig table i.e e.g one two".split()
)


@functools.lru_cache(maxsize=200_000)
def classify(word: str) -> str:
    if regex.fullmatch(r"\p{Han}", word):
        return word
    if regex.search(r"\d", word):
        return "M" if regex.search(r"\p{L}{2}", word) else "N"
    if not regex.search(r"\p{L}", word):
        return word
    low = word.lower()
    if low in CLOSED_CLASS:
        return low
    if regex.search(r"\p{Lu}", word[1:]) or word[:1].isupper():
        return "M"
    return "r" if low.endswith("ly") else "s" if low.endswith("s") and not low.endswith(("ss", "us", "is")) else "d" if low.endswith("ed") else "w"


def shapes(sentence: str) -> list[str]:
    """The sentence's words by class, the first one without regard to its capital, Han text by its characters."""
    words = _WORD.findall(sentence)
    kinds = [classify(w) for w in words]
    if words and kinds[0] == "M" and words[0][1:].islower():
        kinds[0] = classify(words[0].lower())
    while kinds and kinds[-1] in ".!?。！？…*_`\"'”’)]":
        kinds.pop()
    merged: list[str] = []
    for k in kinds:  # a name of several words is one name
        if not (k == "M" and merged and merged[-1] == "M"):
            merged.append(k)
    return merged


_ENTRY = re.compile(r"\s*\[\d+\]\s")


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text; an entry of a reference list is one line, whatever points it holds."""
    found: list[str] = []
    for line in text.split("\n"):
        at = 0
        if not _ENTRY.match(line):
            for m in _SENTENCE.finditer(line):
                found.append(line[at : m.end()])
                at = m.end()
        found.append(line[at:])
    return [s for s in (p.strip() for p in found) if s]


#: How many of a sentence's last classes show how it ends, of a title fewer; a shorter sentence is shown whole.
DEPTH, TITLE_DEPTH = 5, 4
_HAN = regex.compile(r"\p{Han}")
_CLAUSE = regex.compile(r"[，,；;：:]")
_PHRASE = regex.compile(r"[的了或中与在对于为到用从]?[^的了或中与在对于为到用从]*$")


def end_keys(sentence: str, kind: str | None) -> list[str]:
    """What must have been seen at the end of whole sentences for this one to be whole: the classes of its last words;
    in Han text the frame of its last clause, and its last phrase."""
    if not sentence.isascii() and len(_HAN.findall(sentence)) * 3 > len(sentence):
        clause = regex.sub(r"[。！？.\s]+$", "", _CLAUSE.split(sentence.rstrip("。！？"))[-1])
        classed = regex.sub(r"[A-Za-z][A-Za-z0-9\-]*(?:\s[A-Z][a-z]+)?", "M", regex.sub(r"\d+(?:\.\d+)?", "N", clause))
        return [f"h:{classed[:2]}|{classed.count('的')}|{classed.count('或')}", f"p:{_PHRASE.search(classed).group()}"]
    kinds, depth = shapes(sentence), TITLE_DEPTH if kind == "title" else DEPTH
    key = ("^" if len(kinds) <= depth else "") + " ".join(kinds[-depth:])
    return [f"{'t' if kind == 'title' else 'e'}:{key}"]


class Nesting:
    """A stack automaton over brackets, quotes, code fences and markup. `open_at` is where the oldest mark that is still
    open stands, or -1."""

    PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "「": "」", "『": "』", "《": "》", "（": "）"}  # noqa: RUF012
    _TOKENS = regex.compile(r"```|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>\n]*)?(/?)>|[(\[{“「『《（)\]}”」』》）]")
    VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "sup", "sub"})

    def __init__(self, text: str) -> None:
        stack: list[tuple[str, int]] = []
        for m in self._TOKENS.finditer(text):
            t = m.group()
            if t == "```":
                if stack and stack[-1][0] == "```":
                    stack.pop()
                else:
                    stack.append(("```", m.start()))
            elif m.group(2):
                name = m.group(2).lower()
                if m.group(1):
                    if any(s == name for s, _ in stack):
                        while stack.pop()[0] != name:
                            pass
                elif not m.group(3) and name not in self.VOID:
                    stack.append((name, m.start()))
            elif t in self.PAIRS:
                stack.append((self.PAIRS[t], m.start()))
            elif stack and stack[-1][0] == t:
                stack.pop()
            elif any(s == t for s, _ in stack):
                while stack.pop()[0] != t:
                    pass
        self.open = stack


#: Escapes or bytes that stop halfway: the replacement character, half an entity, \\u or percent escape at the end.
_BROKEN = regex.compile("(?r)(?:\ufffd\\s*|&#?[a-zA-Z0-9]{1,6}|\\\\u[0-9a-fA-F]{0,3}|\\\\x[0-9a-fA-F]?|(?<!\\d)%[0-9a-fA-F]?|[\ud800-\udbff])")


_LAST_WORD = regex.compile(r"(?r)[\p{L}\p{N}][\p{L}\p{N}\p{M}'’\-]*")
_WHOLE_NUMBER = regex.compile(r"(?r)(?:^|\s)\d+\.")
_ABBREVIATED = regex.compile(r"(?r)\b(?:al|cf|Sec|Fig|Figs|Eq|Proc|Tech|rep|no|vol|Vol|pp|vs|e\.g|i\.e)\.")


def ending(text: str) -> dict:
    """What the end of a text shows by itself."""
    body = text.rstrip()
    note = _NOTE.match(body)
    noted = body[: note.start()] if note else body
    mark = _MARK.match(noted)
    bare = noted[: mark.start()].rstrip() if mark else noted
    parts = sentences(bare)
    last = parts[-1] if parts else ""
    closed = bool(_CLOSED.match(bare)) or (bool(mark) and not bare)
    word = _LAST_WORD.match(bare)
    stack = Nesting(bare).open
    at = bare.rfind(last) if last else 0
    if closed and _ABBREVIATED.match(bare):
        closed = False
    return {
        "broken": bool(_BROKEN.match(text)),
        "mark": bool(mark),
        "closed": closed,
        "number": bool(_WHOLE_NUMBER.match(bare)),
        "inside": any(p >= at for _, p in stack),
        "last_word": word.group() if word else "",
        "last": last,
        "parts": parts,
    }


_TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'’\-]*")
_CITED = regex.compile(r"(?r)(?:\s*\[[^\[\]\n]{1,12}\])+")
#: Kinds of documents whose lines end without a closing mark.
LISTS = frozenset({"review_note", "reference_list", "title"})
#: An end is known if, of all sentences and texts that end so, no more than this share are texts without a closing mark; a word
#: is known if, of all places it stands, no more than this share are the ends of such texts. Of whole texts that lack only
#: their mark the share is a few per cent. Of titles, which have no closing marks to tell the whole from the cut, the others
#: that end so must make up TITLE_SHARE. All three are shares, which a larger corpus leaves as they are.
OPEN_SHARE, TITLE_SHARE = 0.25, 0.01
#: A length is the field limit of a source if this share of its unfinished texts stop there, and if so many at one length would
#: come about by chance, over as many lengths as the source's texts have, with a likelihood of exp(-LIMIT_EVIDENCE) at most.
LIMIT_SHARE, LIMIT_EVIDENCE = 0.05, 5.0
#: Distinct keys a task counts before it hands them on.
FLUSH = 200_000


def scan(documents: DataFrame) -> DataFrame:
    """One pass over all texts: a row per document with what its end shows, and rows (key, n) that count how whole
    sentences end and which words stand inside texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if not r.text.strip():
                    continue
                e = ending(r.text)
                parts = e["parts"] if r.text.rstrip().endswith(e["last"]) else sentences(r.text)
                whole = parts if r.doc_kind == "title" or e["closed"] else parts[:-1]
                for s in whole:
                    if r.doc_kind in LISTS or _CLOSED.match(s):
                        m = _CITED.match(s) if s.endswith("]") else None
                        counts.update(end_keys(s[: m.start()] if m else s, r.doc_kind))
                words = _TOKEN.findall(r.text)
                counts.update({f"w:{w}": n for w, n in Counter(words if e["closed"] else words[:-1]).items()})
                is_open = not e["closed"]
                last = e["last_word"]
                longer = is_open and len(last) > 1 and last[0].isupper() and last not in words[:-1] and any(w.startswith(last) and w != last for w in words[:-1])
                keys = end_keys(e["last"], r.doc_kind) if is_open and e["last"] else []
                if is_open and last and not regex.search(r"\p{Han}|\d", last):
                    keys = [*keys, f"w:{last}"]
                off = r.doc_kind not in LISTS and r.n_chars is not None and r.n_chars > len(r.text) + 1
                rows.append((r.doc_id, r.source, r.doc_kind, len(r.text), len(r.text.encode("utf-8", "replace")), e["closed"], e["broken"], e["mark"] and is_open, is_open and e["inside"], is_open and longer, e["number"], bool(off), keys, None, None))
            yield pd.DataFrame(rows, columns=_COLUMNS)
            if len(counts) > FLUSH:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "source", "doc_kind", "text", F.col("n_chars").cast("double").alias("n_chars"))
    return texts.mapInPandas(run, _SCHEMA)


_SCHEMA = "doc_id bigint, source string, doc_kind string, chars int, bytes int, closed boolean, broken boolean, marked boolean, inside boolean, longer boolean, number boolean, off boolean, keys array<string>, key string, n bigint"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _counted(counts: Counter[str]) -> pd.DataFrame:
    frame = pd.DataFrame({c: pd.Series([None] * len(counts), dtype=object) for c in _COLUMNS})
    return frame.assign(key=list(counts.keys()), n=list(counts.values()))


def evidence(documents: DataFrame) -> DataFrame:
    """(doc_id, source, broken, marked, nested, unknown, limit, longer, cut) of every document (doc_id, text, n_chars, source,
    doc_kind) with a text that isn't blank: each kind of evidence, and whether the text was cut.

    A stack automaton over brackets, quotes and markup (nested), the state of bytes and escapes (broken), and marks of omission
    (marked) settle what they can. A text that ends without a closing mark is cut unless its end is one that whole sentences
    have: its last word is known and no beginning of a name above, its last words are of classes seen at ends (unknown), its
    length isn't the field limit of its source (limit), and n_chars doesn't say that more was there (longer). What whole
    sentences and words look like, and the limits, are shares counted over all documents. Repeated rows count once, null text
    is in no row, null n_chars and sources are evidence of nothing.
    """
    rows = cut(scan(documents.select("doc_id", "text", "n_chars", "source", "doc_kind").distinct()))
    docs = rows.where("key is null").drop("key", "n")
    counts = rows.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    titles = counts.where(F.col("key").startswith("t:")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("titles"))
    wanted = docs.where("not closed").select("doc_id", F.explode("keys").alias("key"))
    ends = wanted.groupBy("key").agg(F.count("*").alias("open")).join(counts, "key", "left").crossJoin(F.broadcast(titles))
    n = F.coalesce("n", F.lit(0))
    strange = F.when(F.col("key").startswith("t:"), n - 1 < F.col("titles") * TITLE_SHARE).otherwise(F.col("open") > (n + F.col("open")) * OPEN_SHARE)
    unknown = spread_join(wanted, cut(ends.where(strange).select("key")), "key").select("doc_id").distinct().withColumn("unknown", F.lit(True))
    found = docs.join(unknown, "doc_id", "left")
    limits = F.broadcast(field_limits(docs))
    for unit in ("chars", "bytes"):
        here = limits.where(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.lit(True).alias(f"at_{unit}"))
        found = found.join(here, ["source", unit], "left")
    no = F.lit(False)
    title = F.col("doc_kind").eqNullSafe("title")
    limit = (F.coalesce("at_chars", no) | F.coalesce("at_bytes", no)) & ~title
    seen = found.select("doc_id", "source", "closed", "number", "broken", "marked", F.col("inside").alias("nested"), F.coalesce("unknown", no).alias("unknown"), limit.alias("limit"), (F.col("off") | F.col("longer")).alias("longer"))
    hint = F.col("limit") | F.col("longer")
    is_cut = F.col("broken") | F.col("marked") | F.when(F.col("closed"), F.col("number") & hint).otherwise(F.col("nested") | F.col("unknown") | hint)
    return seen.withColumn("cut", is_cut).drop("closed", "number")


def field_limits(docs: DataFrame) -> DataFrame:
    """(source, unit, size): the lengths at which a source cuts its texts; at most 1 / LIMIT_SHARE a source and unit."""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))
    lengths = docs.where("source is not null").select("source", F.when(~F.col("closed") & ~F.col("doc_kind").eqNullSafe("title"), 1).otherwise(0).alias("is_open"), F.explode(units).alias("l")).groupBy("source", "l.unit", "l.size").agg(F.sum("is_open").alias("here"))
    per = lengths.groupBy("source", "unit").agg(F.sum("here").alias("open"), F.count("*").alias("lengths"))
    chance = F.col("open") / F.col("lengths")
    likely = F.col("here") * F.log(F.col("here") / chance) - (F.col("here") - chance)
    return lengths.where("here > 0").join(per, ["source", "unit"]).where((F.col("here") >= F.col("open") * LIMIT_SHARE) & (F.col("here") > chance) & (likely >= LIMIT_EVIDENCE)).select("source", "unit", "size")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut) of every document with a text that isn't blank; see `evidence`."""
    return evidence(documents).select("doc_id", "source", "cut")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents with a text, those cut, and their share; a null source is its own row."""
    per = truncated(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"))
    return per.withColumn("share", F.col("cut") / F.col("documents"))


def p10_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, documents, cut, alone): how many documents show each kind of evidence, how many of those were cut, and how many
    show no other kind."""
    kinds = ("broken", "marked", "nested", "unknown", "limit", "longer")
    shown = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))
    rows = evidence(table(spark, sf_dir, "documents")).select("cut", shown.alias("kinds"))
    each = rows.select("cut", (F.size("kinds") == 1).alias("only"), F.explode("kinds").alias("kind"))
    return each.groupBy("kind").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("only")).alias("alone"))


QUERIES = {"p10_found": p10_found, "p10_sources": p10_sources, "p10_evidence": p10_evidence}
SQL: dict[str, str] = {}
