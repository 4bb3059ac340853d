"""Other sources and sinks: strict JSON lines, audit appends, event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under an explicit schema. strict fails on the first bad row; otherwise bad rows come with their text in
    _corrupt_record."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the lines that aren't blank, from 1. Files are read whole, which is for manifests and evaluation sets."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    return text.where(F.trim("line") != "").select("file", (F.col("i") + 1).alias("line_no"), "line")


def read_checked(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of JSON lines under a schema, refused as a whole, with file and line of the first fault, if a line is no record, a key
    stands twice or is missing, or there is no record at all."""
    kind = T._parse_datatype_string(schema)
    wide = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    rows = numbered_lines(spark, path).select("file", "line_no", F.from_json("line", wide, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("file", "line_no", "r.*")
    again = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct("file", "line_no")).alias("at")).where(F.col(key).isNotNull() & (F.col("n") > 1)).select("at.file", "at.line_no", F.lit("a key that stands twice").alias("fault"))
    faults = rows.where(F.col("_corrupt").isNotNull() | F.col(key).isNull()).select("file", "line_no", F.lit("no record").alias("fault")).unionByName(again)
    first = faults.orderBy("file", "line_no").first()
    if first is not None:
        raise ValueError(f"{first.file}, line {first.line_no}: {first.fault}")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no record")
    return rows.select(*[f.name for f in kind.fields])


def write_report(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small table as report.json and report.md in a folder that appears at once: it is written beside its place and renamed. A
    table of more than `most` rows is no report and is refused."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    spark = df.sparkSession
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'-|' * len(rows.columns)}\n"
    body = "".join(f"| {' | '.join(str(v) for v in r)} |\n" for r in rows.itertuples(index=False))
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = f"{path.rstrip('/')}.part"
    for name, text in (("report.json", rows.to_json(orient="records", date_format="iso", force_ascii=False)), ("report.md", head + body)):
        out = fs.create(hadoop(f"{beside}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(beside), hadoop(path))


def unknown_keys(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose JSON object has a key outside the allowed ones, with those keys."""
    extra = F.array_except(F.json_object_keys(column), F.array(*[F.lit(k) for k in allowed]))
    return df.withColumn("extra", extra).where(F.size("extra") > 0)


def append_audit(df: DataFrame, path: str, allowed: list[str], by: str) -> None:
    """Append allow-listed columns as JSON lines, one folder per value of `by`."""
    df.select(*[c for c in df.columns if c in allowed or c == by]).write.mode("append").partitionBy(by).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sse_frames(events: DataFrame) -> DataFrame:
    """(event_id, frame): events as text frames whose id is the reader's cursor."""
    return events.select("event_id", F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.col("event_type"), F.lit("\ndata: "), F.col("props"), F.lit("\n\n")).alias("frame"))
