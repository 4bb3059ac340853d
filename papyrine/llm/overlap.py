"""Same or nearly the same requests across splits."""

from __future__ import annotations

import functools
import json
import math
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.splits import norm_split
from papyrine.plans.runtime import cut
from papyrine.sources.tables import table

#: Bands of BAND_ROWS minwise hashes each. A pair whose shingles have Jaccard similarity s meets in some band with
#: probability 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.985 at 0.35, 0.999 at 0.45.
BANDS, BAND_ROWS = 32, 2
#: Shingles of five words beside them, with longer rows.
WORD_BANDS, WORD_ROWS, WORD_SHINGLE = 16, 5, 5
#: A bucket whose two sides make more pairs than this is dealt over a grid of cells of about as many pairs. Every pair of it still
#: meets, in one cell, and is a candidate unless marks of its words rule out what the verification asks for.
HOT_PAIRS = 250_000
#: A word whose share of all wordings is above this, three standard deviations of its count left aside, is common: headings,
#: parts of names such as "survey", small numbers. Common words are no anchors. A wording has some forty words, so there are a
#: few thousand of them at most.
COMMON_SHARE, COMMON_DEVIATIONS = 0.01, 3
#: Word-set similarity that a pair of requests about the same named things must reach.
SIMILAR = 0.5
#: Hash functions are linear over this prime field; products stay within 64 bits.
_PRIME = (1 << 31) - 1

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "υ": "u", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ı": "i", "ɑ": "a", "ɡ": "g",
})
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_TOKEN = regex.compile(r"[0-9]+(?:\.[0-9]+)?(?![a-z0-9])|[a-z0-9]+|\p{Han}")
_SHAPED = regex.compile(r"[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*")


def plain(text: str) -> str:
    """One form for look-alikes, widths, accents, invisible characters, quotes of mail and white space; case is kept."""
    text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES)
    text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return regex.sub(r"\s+", " ", regex.sub(r"(?m)^\s*>+", " ", text)).strip()


def request_of(value: str | None) -> str | None:
    """The user's request in a sample's input: under `request` at the top or inside an object, or the user's messages.
    Null for null, broken or empty JSON and for what holds no request."""
    if not value:
        return None
    try:
        found = json.loads(value)
    except ValueError:
        return None

    def walk(x: object) -> str | None:
        if not isinstance(x, dict):
            return None
        if isinstance(x.get("request"), str):
            return x["request"]
        if isinstance(x.get("messages"), list):
            said = [m["content"] for m in x["messages"] if isinstance(m, dict) and m.get("role") == "user" and isinstance(m.get("content"), str)]
            return "\n".join(said) or None
        for y in x.values():
            inner = walk(y)
            if inner is not None:
                return inner
        return None

    found = walk(found)
    return found if found and found.strip() else None


def words_of(text: str) -> list[str]:
    """Words in lower case, Han characters one by one; figures without their point, which a stripped text lacks."""
    return [w.replace(".", "") for w in _TOKEN.findall(text.lower())]


@functools.lru_cache(maxsize=200_000)
def _form(word: str) -> tuple[bool, bool, tuple[str, ...]]:
    """(a name wherever it stands, a name inside a sentence, its words)."""
    inner = bool(regex.search(r"[a-z0-9].*[A-Z]|[A-Za-z].*[0-9]|[0-9].*[A-Za-z]", word))
    return inner, word[0].isupper(), tuple(words_of(word)) if any(c.isalpha() for c in word) else ()


def names_of(text: str) -> set[str]:
    """Words that are names by their form: inner capitals, letters with digits, or capitals inside a sentence."""
    found: set[str] = set()
    for m in _SHAPED.finditer(text):
        always, capital, parts = _form(m.group())
        if always:
            found.update(parts)
        elif capital and parts:
            i = m.start() - 1
            while i >= 0 and text[i] in " \"'“‘([":
                i -= 1
            if i >= 0 and text[i] not in ".!?:。！？-—–":
                found.update(parts)
    return found


def neighbours(anchors: list[str]) -> list[str]:
    """Shingles of a request's names and figures: each with the next one and the one after."""
    return sorted({f"{a} {b}" for a, b in zip(anchors, anchors[1:], strict=False)} | {f"{a}  {b}" for a, b in zip(anchors, anchors[2:], strict=False)})


def word_shingles(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + WORD_SHINGLE]) for i in range(max(1, len(words) - WORD_SHINGLE + 1))})


_functions: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}


def band_keys(shingles: list[str], bands: int, rows: int, tag: str) -> list[int]:
    """One key a band, from the least of each hash function over the shingles."""
    if (bands * rows, tag) not in _functions:
        source = np.random.default_rng([bands, rows, *tag.encode()])
        _functions[bands * rows, tag] = source.integers(1, _PRIME, bands * rows), source.integers(0, _PRIME, bands * rows)
    a, c = _functions[bands * rows, tag]
    bases = np.array([xxhash.xxh32_intdigest(s) for s in shingles], dtype=np.int64) % _PRIME
    least = ((a[:, None] * bases[None, :] + c[:, None]) % _PRIME).min(axis=1).astype(np.int64).reshape(bands, rows)
    return [xxhash.xxh64_intdigest(row.tobytes() + f"{tag}{b}".encode()) - (1 << 63) for b, row in enumerate(least)]


def one_edit(a: str, b: str) -> bool:
    """Whether a turns into b by one inserted, left out, changed or swapped letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def same_request(a_words: set[str], a_names: set[str], b_words: set[str], b_names: set[str]) -> float | None:
    """The word-set similarity of two requests that ask the same of the same named things; null otherwise.

    Words of one that the other lacks are matched when one letter's slip apart (figures never are). If on both sides
    a name or figure is left over, the requests are about other things.
    """
    only_a, only_b = a_words - b_words, b_words - a_words
    slips = 0
    for w in sorted(only_a):
        if len(w) >= 4 and not any(c.isdigit() for c in w):
            hit = next((v for v in sorted(only_b) if len(v) >= 4 and not any(c.isdigit() for c in v) and one_edit(w, v)), None)
            if hit is not None:
                only_a.discard(w)
                only_b.discard(hit)
                slips += 1
    named = lambda words, names: {w for w in words if w in names or any(c.isdigit() for c in w)}
    if named(only_a, a_names | b_names) and named(only_b, a_names | b_names):
        return None
    shared = len(a_words & b_words) + slips
    return shared / max(1, shared + len(only_a) + len(only_b))


def mixed_case(text: str) -> bool:
    return any(c.isupper() for c in text) and (any(c.islower() for c in text) or bool(regex.search(r"\p{Han}", text)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, split, source, request, wording) of both tables, exact duplicates once; only records with a split
    and a request. wording is the request as bare words."""
    samples = table(spark, sf_dir, "training_samples").select(F.col("sample_id").alias("record_id"), norm_split(F.col("dataset_split")).alias("split"), "source", F.col("input").alias("body"), F.lit(True).alias("json"))
    cases = table(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("record_id"), norm_split(F.col("split")).alias("split"), F.col("source_id").alias("source"), F.col("prompt").alias("body"), F.lit(False).alias("json"))
    both = samples.unionByName(cases).where("record_id is not null and split is not null and body is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = [request_of(b) if j else b for b, j in zip(pdf["body"], pdf["json"], strict=True)]
            pdf["request"] = [plain(x) if x else None for x in asked]
            pdf["wording"] = [" ".join(words_of(x)) if x else None for x in pdf["request"]]
            yield pdf.loc[[bool(w) for w in pdf["wording"]], ["record_id", "split", "source", "request", "wording"]]

    return both.mapInPandas(run, "record_id string, split string, source string, request string, wording string")


def class_key(wording: Column) -> Column:
    """A wording's class: its SHA-256, so that two wordings share one only if they are the same."""
    return F.unhex(F.sha2(wording, 256))


def classes_of(records: DataFrame) -> DataFrame:
    """(class_id, request, mixed, train, held): one row per distinct wording, shown by a request in mixed case if there is one."""
    upper, lower = F.col("request").rlike("[A-Z]"), F.col("request").rlike("[a-z\\u4e00-\\u9fff]")
    shown = F.min(F.struct(~(upper & lower), "request"))
    train = F.col("split") == "train"
    grouped = records.groupBy("class_id").agg(shown.alias("s"), F.max(train).alias("train"), F.max(~train).alias("held"))
    return grouped.select("class_id", F.col("s.request").alias("request"), (~F.col("s.col1")).alias("mixed"), "train", "held")


def with_names(texts: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """Texts with `names`, and the common words. Names are told by form in mixed case; in a text of one case, the words that are names more often than
    not in the others. Both counts are combined map-side; the names found stay distributed."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["names"] = [sorted(names_of(r)) if m else [] for r, m in zip(pdf["request"], pdf["mixed"], strict=True)]
            pdf["words"] = [sorted(set(words_of(r))) for r in pdf["request"]]
            yield pdf

    schema = "class_id binary, request string, mixed boolean, train boolean, held boolean, names array<string>, words array<string>"
    shaped = cut(texts.mapInPandas(shapes, schema))
    named = shaped.where("mixed").select(F.explode("words").alias("word"), "names").groupBy("word").agg(F.sum(F.when(F.array_contains("names", F.col("word")), 1).otherwise(-1)).alias("more")).where("more > 0").select("word")
    plain_ = shaped.where("not mixed").select("class_id", F.explode("words").alias("word")).join(named, "word").groupBy("class_id").agg(F.collect_set("word").alias("found"))
    seen = shaped.select(F.explode("words").alias("word")).groupBy("word").count()
    sure = F.col("count") - COMMON_DEVIATIONS * F.sqrt("count") > COMMON_SHARE * shaped.count()
    common = frozenset(r[0] for r in seen.where(sure).select("word").collect())
    return cut(shaped.join(plain_, "class_id", "left").select("class_id", "request", "train", "held", F.coalesce("found", "names").alias("names"))), common


def bucket_pairs(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): classes with train records and classes with others that share a bucket."""
    left = keyed.where("train").select(*keys, F.col("class_id").alias("a"))
    right = keyed.where("held").select(*keys, F.col("class_id").alias("b"))
    return left.join(right, keys).where("a <> b").select("a", "b").distinct()


def _bits(words: Iterable[str]) -> int:
    """Words as bits of a mask: a word that one set has and another lacks may be hidden, but none is missing that both have."""
    mask = 0
    for w in words:
        mask |= 1 << xxhash.xxh32_intdigest(w) % 63
    return mask


def marks_of(request: str, names: list[str]) -> tuple[int, int, int, int]:
    """(size, figures, names, shorts): how many words, and masks of those with a digit, of names below four letters and of all
    words below four letters. same_request matches such words by equality alone."""
    words = set(words_of(request))
    figures = {w for w in words if any(c.isdigit() for c in w)}
    shorts = {w for w in words - figures if len(w) < 4}
    return len(words), _bits(figures), _bits(shorts & set(names)), _bits(shorts)


def may_be_same() -> Column:
    """False only for pairs (a_size, ..., b_shorts) that same_request puts below SIMILAR: those of very unequal size, and those
    with a figure or short name left over on both sides."""
    lacks = lambda x, y: (F.col(x).bitwiseAND(F.bitwise_not(y)) != 0)
    over = lambda x, y: lacks(f"{x}_figures", f"{y}_figures") | lacks(f"{x}_names", f"{y}_shorts")
    return (F.least("a_size", "b_size") >= (SIMILAR - 1e-9) * F.greatest("a_size", "b_size")) & ~(over("a", "b") & over("b", "a"))


def grid_pairs(rows: DataFrame, hot: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) as from bucket_pairs, less those that cannot be the same, for hot buckets: members (key, class_id, train, held) and the
    number of each side's members (key, t, h)."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [marks_of(r, list(n)) for r, n in zip(pdf["request"], pdf["names"], strict=True)]
            yield pd.DataFrame({"class_id": pdf["class_id"]} | {x: [f[i] for f in found] for i, x in enumerate(marks)})

    marks = ("size", "figures", "names", "shorts")
    members = texts.join(rows.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "request", "names")
    marked = members.mapInPandas(mark, "class_id binary, size bigint, figures bigint, names bigint, shorts bigint")
    shares = lambda n: F.ceil(F.col(n) / math.sqrt(HOT_PAIRS)).cast("int")
    dealt = rows.join(hot.select("key", shares("t").alias("ts"), shares("h").alias("hs")), "key").join(marked, "class_id")
    own = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda x: [F.col("class_id").alias(x), *[F.col(m).alias(f"{x}_{m}") for m in marks]]
    left = dealt.where("train").select("key", own("ts").alias("i"), every("hs").alias("j"), *side("a"))
    right = dealt.where("held").select("key", every("ts").alias("i"), own("hs").alias("j"), *side("b"))
    return left.join(right, ["key", "i", "j"]).where((F.col("a") != F.col("b")) & may_be_same()).select("a", "b").distinct()


def similar_classes(texts: DataFrame, common: frozenset[str]) -> DataFrame:
    """(a, b, similarity): pairs of classes that ask the same, a with records of the train split, b with others.

    Minwise hashes of each class's shingles are banded; only classes that could form a cross-split pair meet in a
    bucket. Every candidate is then held against the whole texts: exact Jaccard similarity of the words, and the same
    named things. A class is one distinct wording, so copies never multiply candidates. How large a bucket is decides how its
    pairs are formed, not which are found.
    """

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                words, names = words_of(r.request), set(r.names)
                anchors = [w for w in words if w not in common and (w in names or any(c.isdigit() for c in w))]
                keys = band_keys(neighbours(anchors), BANDS, BAND_ROWS, "n") if len(anchors) > 1 else []
                keys += band_keys(word_shingles(words), WORD_BANDS, WORD_ROWS, "w")
                rows.extend((k, r.class_id, r.train, r.held) for k in keys)
            yield pd.DataFrame(rows, columns=["key", "class_id", "train", "held"])

    keyed = cut(texts.where("train or held").select("class_id", "request", "names", "train", "held").mapInPandas(shingle, "key bigint, class_id binary, train boolean, held boolean"))
    crossing = keyed.groupBy("key").agg(F.count_if("train").alias("t"), F.count_if("held").alias("h"))
    hot = cut(crossing.where(F.col("t") * F.col("h") > HOT_PAIRS))
    if hot.isEmpty():
        candidates = bucket_pairs(keyed, ["key"])
    else:
        met = grid_pairs(keyed.join(hot.select("key"), "key", "left_semi"), hot, texts)
        candidates = bucket_pairs(keyed.join(hot.select("key"), "key", "left_anti"), ["key"]).unionByName(met).distinct()
    side = lambda x: texts.select(F.col("class_id").alias(x), F.col("request").alias(f"{x}_request"), F.col("names").alias(f"{x}_names"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [same_request(set(words_of(r.a_request)), set(r.a_names), set(words_of(r.b_request)), set(r.b_names)) for r in pdf.itertuples()]
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": [-1.0 if x is None else x for x in found]})
            yield out[out["similarity"] >= SIMILAR]

    return candidates.join(side("a"), "a").join(side("b"), "b").mapInPandas(verify, "a binary, b binary, similarity double")


def p3_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records with their class, and pairs of classes (each class with itself where it stands in train and elsewhere)."""
    records = cut(requests(spark, sf_dir).withColumn("class_id", class_key(F.col("wording"))))
    texts = classes_of(records)
    texts, common = with_names(texts)
    pairs = similar_classes(texts, common).select("a", "b").unionByName(texts.where("train and held").select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    return records, cut(pairs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of record keys, the smaller first, one in train and one elsewhere. Records with a null key, split or request,
    broken or empty JSON, or a request without a word are in no pair; repeated rows count once; empty tables give none."""
    records, pairs = p3_links(spark, sf_dir)
    train = records.where("split = 'train'").select(F.col("class_id").alias("a"), F.col("record_id").alias("x"))
    held = records.where("split <> 'train'").select(F.col("class_id").alias("b"), F.col("record_id").alias("y"))
    found = pairs.join(train, "a").join(held, "b").where("x <> y")
    return found.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()


def p3_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the held-out record: how many of its records overlap with train, in how many classes of
    wording. A null source is its own row. Pairs aren't expanded for this."""
    records, pairs = p3_links(spark, sf_dir)
    hit = pairs.select(F.col("b").alias("class_id")).distinct()
    held = records.where("split <> 'train'").join(hit.withColumn("hit", F.lit(True)), "class_id", "left")
    return held.groupBy("split", "source").agg(F.countDistinct("record_id").alias("records"), F.countDistinct(F.when(F.col("hit"), F.col("record_id"))).alias("overlapping"), F.countDistinct(F.when(F.col("hit"), F.col("class_id"))).alias("classes"))


QUERIES = {"p3_found": p3_found, "p3_overlap": p3_overlap}
SQL: dict[str, str] = {}
