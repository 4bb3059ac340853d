"""Document structure: repeated lines, packing of blocks, sections from paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_lines(chunks: DataFrame) -> DataFrame:
    """(file_id, line, chunks): lines that stand in two or more of a file's chunks, and in at least half of them."""
    sizes = chunks.groupBy("file_id").agg(F.count("*").alias("n"))
    lines = chunks.select("file_id", "chunk_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    counts = lines.groupBy("file_id", "line").agg(F.count("*").alias("chunks")).where("chunks >= 2")
    return counts.join(sizes, "file_id").where(F.col("chunks") >= F.floor((F.col("n") + 1) / 2)).select("file_id", "line", "chunks")


def pack_blocks(df: DataFrame, key: str, blocks: str, limit: int) -> DataFrame:
    """(key, chunk_no, first_block, n_blocks, n_chars): blocks packed in order; a new chunk begins when the next block
    would take a chunk that isn't empty above the limit. A larger block stays whole. One pass over each row's block sizes, in
    batches that hold no text; no shuffle."""

    @F.pandas_udf("array<struct<first:int,n:int,size:int>>")
    def packed(sizes: pd.Series) -> pd.Series:
        def one(row: np.ndarray | None) -> list[tuple[int, int, int]]:
            out, first, used = [], 0, 0
            for i, size in enumerate([] if row is None else row.tolist()):
                if i > first and used > 0 and used + size > limit:
                    out.append((first, i - first, used))
                    first, used = i, 0
                used += size
            return [*out, (first, len(row) - first, used)] if row is not None and len(row) else out

        return sizes.map(one)

    sized = df.select(key, F.transform(blocks, lambda b: F.length(b)).alias("sizes"))
    rows = sized.select(key, packed("sizes").alias("p")).select(key, F.posexplode("p").alias("chunk_no", "c"))
    return rows.select(key, F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("c.first").cast("bigint").alias("first_block"), F.col("c.n").cast("bigint").alias("n_blocks"), F.col("c.size").cast("bigint").alias("n_chars"))


def section_nodes(chunks: DataFrame) -> DataFrame:
    """(file_id, p): every section on the chunks' paths, as the array of titles down to it."""
    paths = chunks.where("file_id is not null and size(section_path) > 0").select("file_id", "section_path").distinct()
    return paths.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda i: F.slice("section_path", 1, i))).alias("p")).distinct()


def section_tree(chunks: DataFrame) -> DataFrame:
    """(file_id, path, parent, level): every section on the chunks' paths with its parent."""
    join = lambda c: F.array_join(c, " / ")
    above = F.slice("p", F.lit(1), F.size("p") - 1)
    return section_nodes(chunks).select("file_id", join(F.col("p")).alias("path"), F.when(F.size("p") > 1, join(above)).alias("parent"), F.size("p").cast("bigint").alias("level"))


def section_closure(chunks: DataFrame) -> DataFrame:
    """(file_id, root, descendants): sections below each section. A section's ancestors are the beginnings of its own path, so each
    is counted under all of them without a join."""
    up = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), " / "))
    rows = section_nodes(chunks).select("file_id", F.explode(up).alias("root"))
    return rows.groupBy("file_id", "root").agg((F.count("*") - 1).alias("descendants"))
