"""Files as rows: shards, feature files, directory conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialise import checkpoint
from . import arrays
from .json_files import whole_document


def shards(spark: SparkSession, folder: str, pattern: str = "shard_*.jsonl") -> DataFrame:
    """(shard, file) of the shard files, by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(F.regexp_extract("path", r"(\d+)\.jsonl(?:\.gz)?$", 1).cast("int").alias("shard"), F.col("path").alias("file")).orderBy("file")


def missing_shards(found: DataFrame, first: int, last: int) -> DataFrame:
    return found.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("shard")).join(found, "shard", "left_anti")


def shard_counts(spark: SparkSession, folder: str, pattern: str = "shard_*.jsonl") -> DataFrame:
    """(file, n) of non-blank lines."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    return lines.where(F.trim("value") != "").groupBy("file").agg(F.count("*").alias("n"))


def present_features(spark: SparkSession, folder: str, suffix: str = ".pt") -> DataFrame:
    """(video_uid) of the files uid + suffix; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.select(F.regexp_extract("path", rf"([^/]+)\{suffix}$", 1).alias("video_uid")).distinct()


def _listing(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    """(file) by the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(F.col("_metadata.file_path").alias("file"))


def numbered_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl", recursive: bool = False) -> DataFrame:
    """(file, line_no, line) of the lines that aren't blank.

    Numbers count blank lines, too, and come from the counts of the byte ranges
    before a line's own, so a file's lines are numbered by many tasks.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(folder)
    at = checkpoint(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line")))
    counts = at.groupBy("file", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file").orderBy("block")
    before = counts.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("k"))
    return at.withColumn("nth", nth).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("nth")).alias("line_no"), "line").where(F.trim("line") != "")


def converted_name(path: Column) -> Column:
    """Where a JSON lines file's array goes."""
    return F.concat(F.regexp_replace(path, r"(\.txt)?(\.jsonl)?(\.gz)?$", ""), F.lit("_converted.json"))


def convert_folder(spark: SparkSession, folder: str, pattern: str = "*.jsonl", recursive: bool = False, out_folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write each file of a folder, but those converted already, as one JSON array.

    (files, bad): (file, out) and (file, line_no, line) of the lines that are
    not JSON and are skipped.  One job writes all files: lines are dealt out by
    file and sorted, and a task streams its files out, whatever their number
    and sizes; results appear when all are written.  Files without a byte have none.
    """
    out = converted_name(F.col("file"))
    if out_folder:
        name = F.element_at(F.split(out, "/"), -1)
        # names of listed files are those of URIs
        plain = name if ":/" in out_folder else F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        out = F.concat(F.lit(out_folder.rstrip("/") + "/"), plain)
    found = checkpoint(_listing(spark, folder, pattern, recursive).where(~F.element_at(F.split("file", "/"), -1).contains("_converted")).select("file", out.alias("out")))
    if not found.limit(1).count():
        return found, spark.createDataFrame([], "file string, line_no bigint, line string")
    lines = checkpoint(numbered_lines(spark, folder, pattern, recursive).join(found, "file").withColumn("good", whole_document(F.col("line")).isNotNull()))
    # a row for each file opens its array, even if no line of it is JSON
    every = lines.where("good").select("out", "line_no", "line").unionByName(found.select("out", F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line")))
    arrays.register(spark)
    every.repartition("out").sortWithinPartitions("out", "line_no").select("out", "line").write.format("json_arrays").mode("append").save(out_folder or folder)
    return found, lines.where("NOT good").select("file", "line_no", "line")
