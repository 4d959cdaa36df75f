"""Readers and writers of record sets: JSON lines, CSV, text, images, archives, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.scalars import stripped
from loomlake.functions.trace import SCHEMA
from loomlake.operators.shards import numbered
from loomlake.sources import sinks


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, in any store that Spark reaches."""
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def read_jsonl(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """JSON lines; blank lines are skipped, bad JSON and missing files are errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, but no file is an empty table."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, folder: str, schema: str = SCHEMA, pattern: str = "*.trace.json") -> DataFrame:
    """One JSON document a file, all files of a folder in one scan."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)


def read_prompts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(pos, prompt): non-blank lines, trimmed, in the order of file names and of their lines; the first `limit` of them.

    Each file is one row until it is split, so that its lines have numbers of their own.
    """
    whole = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    lines = whole.select("file_path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line", "text")).select("file_path", "line", stripped(F.col("text")).alias("prompt")).filter("prompt <> ''")
    rows = numbered(lines.withColumn("at", F.struct("file_path", "line")), "at").select(F.col("row").alias("pos"), "prompt")
    return rows if limit is None else rows.filter(F.col("pos") < max(0, limit))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text, empty cells as empty text."""
    return spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path).na.fill("")


def image_files(spark: SparkSession, folder: str, pattern: str = "*.webp") -> DataFrame:
    """(path, file): names of images; their bytes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("file"))
    return files.select(F.regexp_extract("file", "([^/]+)$", 1).alias("path"), "file")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_records(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """CSV with a header; formats gives printf forms of numeric columns."""
    shaped = df.withColumns({c: F.format_string(f, c) for c, f in (formats or {}).items()})
    shaped.write.mode("overwrite").option("header", True).csv(path)


def label_sheet(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows for human labels: id, prompt, metrics and an empty human_good."""
    return df.select("id", "prompt", *metrics, F.lit("").alias("human_good"))


def write_document(df: DataFrame, path: str) -> dict:
    """A table of one row as one pretty JSON file; returns it."""
    row = json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])
    write_text(df.sparkSession, path, json.dumps(row, indent=2, ensure_ascii=False))
    return row


def write_shards(records: DataFrame, folder: str, images: DataFrame | None = None) -> DataFrame:
    """One archive a shard of records (id, json, row, shard), with images (id, idx, content) beside them.

    Records stand in an archive by row, each before its images. The archives are files of the folder, complete or
    absent; what is returned, (shard, n_records, n_images, bytes), is read back from them.
    """
    rows = records.select(F.col("shard").alias("archive"), "row", F.lit(-1).alias("idx"), F.concat("id", F.lit(".json")).alias("name"), F.col("json").cast("binary").alias("data"))
    if images is not None:
        places = records.select("id", "shard", "row")
        more = images.join(places, "id").select(F.col("shard").alias("archive"), "row", "idx", F.concat("id", F.lit("."), F.col("idx").cast("string"), F.lit(".webp")).alias("name"), F.col("content").alias("data"))
        rows = rows.unionByName(more)
    sinks.write_archives(rows, folder, ["row", "idx"])
    return shard_counts(records.sparkSession, folder)


def shard_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, n_records, n_images, bytes) of the archives of a folder."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "shard string, n_records long, n_images long, bytes long")
    members = sinks.archive_members(spark, folder)
    counts = members.groupBy("archive").agg(F.count_if(F.col("name").endswith(".json")).alias("n_records"), F.count_if(~F.col("name").endswith(".json")).alias("n_images"))
    return counts.join(sinks.archive_files(spark, folder), "archive").select(F.col("archive").alias("shard"), "n_records", "n_images", "bytes")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write images (id, idx, content) as {id}_{idx}.webp; (path, bytes) of each.

    A file is complete or absent, and writing one again replaces it.
    """
    named = images.select(F.concat("id", F.lit("_"), F.col("idx").cast("string"), F.lit(".webp")).alias("name"), F.col("content").alias("data"))
    sinks.write_files(named, folder)
    return named.select(F.col("name").alias("path"), F.octet_length("data").cast("long").alias("bytes"))


def image_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, idx, content) of the images {id}_{idx}.webp of a folder."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.webp").load(folder)
    parts = [F.regexp_extract("path", r"([^/]+)_(\d+)\.webp$", k) for k in (1, 2)]
    return read.select(parts[0].alias("id"), parts[1].cast("int").alias("idx"), "content").filter("id <> ''")


def tail(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The last n rows by order, in order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def positions(df: DataFrame, order: str) -> DataFrame:
    """Add pos within a small table; large ones take shards.numbered."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)
