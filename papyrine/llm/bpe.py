"""The corpus in ids of a public byte-level BPE tokenizer, by tree reduction over parts of a text."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import table

#: Folder of the public tokenizers' files, the file of byte_bpe_50k in it, and its published pre-token pattern (fixed value).
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf of the tree. Shorter texts are one leaf.
LEAF = 256
#: Where every scan of the pattern begins a new match, wherever it came from: behind a letter or digit before a character of
#: another kind, and behind a mark before a letter, digit or space. Apostrophes may begin a contraction and are left out; so
#: are rare characters, whose kind may differ between versions of Unicode.
_LETTER, _DIGIT, _MARK, _SPACE = "A-Za-zÀ-ÖØ-öø-ʯΑ-Ωα-ωА-яぁ-ゖァ-ヺ一-鿿", "0-9", "!-&(-/:-@\\[-`{-~，。；：、（）《》“”！？—…", " \n"
SYNC = regex.compile(f"(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}{_SPACE}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_MARK}{_SPACE}])|(?<=[{_MARK}])(?=[{_LETTER}{_DIGIT}{_SPACE}])")
#: The first characters of the window over a border, on each side.
WINDOW = 16

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding_of(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a rank file's content, built once in a process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encodings:
        table_ = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        _encodings[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
    return _encodings[key]


class TreeEncoder:
    """Encodes halves recursively and joins neighbours by re-encoding a window over their border.

    No id crosses a point of SYNC, and the ids between two such points depend on the text between them alone, up to the
    character after the second. Joining two parts, the window begins at the last such point that lies in the left part, one
    character or more before its end, and ends at the first one in the right part; it is sought in stretches that grow until
    it is found, up to the whole part. The ids outside the window hold; those inside are encoded anew. How many ids of a part
    lie in the window is known by encoding its share of the window as the part had it.
    """

    def __init__(self, encoding: tiktoken.Encoding, leaf: int = LEAF) -> None:
        self.encoding, self.leaf = encoding, leaf

    def encode(self, text: str) -> list[int]:
        return self.part(text, 0, len(text))

    def part(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.encoding.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self.part(text, start, middle), self.part(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        encode = self.encoding.encode_ordinary
        at, width = start, WINDOW
        while middle - width > start:
            found = [m.start() for m in SYNC.finditer(text, middle - width, middle) if middle - width < m.start() < middle]
            if found:
                at = found[-1]
                break
            width *= 2
        to, width = end, WINDOW
        while middle + width < end:
            m = SYNC.search(text, middle + 1, middle + width)
            if m and middle + 1 < m.start() < middle + width:
                to = m.start()
                break
            width *= 2
        kept = len(left) - len(encode(text[at:middle]))
        return left[:kept] + encode(text[at:to]) + right[len(encode(text[middle:to])) :]

    def decode(self, ids: list[int]) -> str:
        """Bytes of the halves, put together up the tree; characters may cross a border, so text is made last."""

        def up(a: int, b: int) -> bytes:
            if b - a <= self.leaf:
                return self.encoding.decode_bytes(ids[a:b])
            m = (a + b) // 2
            return up(a, m) + up(m, b)

        return up(0, len(ids)).decode("utf-8", errors="replace")


def rank_file(folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> bytes:
    return Path(folder, name).read_bytes()


def encode_column(df: DataFrame, key: str, text: str, ranks: bytes, leaf: int = LEAF, sizes_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens): an empty text has no ids, a null text null.

    Rows are encoded where they are read, without a shuffle, in Arrow batches; the vocabulary is a file of fixed size
    that is broadcast. Repeated rows and null keys are kept; other columns are ignored.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TreeEncoder(encoding_of(shared.value), leaf)
        for pdf in batches:
            ids = [None if t is None else tree.encode(t) for t in pdf["t"]]
            if sizes_only:
                yield pd.DataFrame({"k": pdf["k"], "n_tokens": pd.array([None if x is None else len(x) for x in ids], dtype="Int64")})
            else:
                yield pd.DataFrame({"k": pdf["k"], "ids": pd.Series(ids, dtype=object)})

    schema = f"k {kind}, " + ("n_tokens bigint" if sizes_only else "ids array<int>")
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema).withColumnRenamed("k", key)


def spread_scan(df: DataFrame, column: str) -> DataFrame:
    """Rows dealt out evenly where the input has fewer partitions than the cluster has cores: tokenizing costs far more
    than moving the text once."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    wanted = max(cores * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, column) if df.rdd.getNumPartitions() < cores else df


def decode_column(df: DataFrame, key: str, ids: str, ranks: bytes) -> DataFrame:
    """(key, text) of every row (key, ids): no ids are an empty text, null ids a null one."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TreeEncoder(encoding_of(shared.value))
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "text": [None if x is None else tree.decode(list(x)) for x in pdf["ids"]]})

    return df.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(spread_scan(documents, "doc_id"), "doc_id", "text", rank_file())


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, digest) of every document's text after encoding and decoding: the round trip of the whole corpus."""
    texts = decode_column(p8_ids(spark, sf_dir), "doc_id", "ids", rank_file())
    return texts.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {"p8_decoded": "select doc_id, length(text) as n_chars, md5(text) as digest from documents"}
