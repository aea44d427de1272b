"""Sinks: tables, shards, JSON lines, CSV audits, nested documents, ledgers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialise import scratch
from . import arrays as named
from . import exports
from .staged import located


def write_catalog(candidates: DataFrame, path: str, files: int | None = None) -> None:
    """Candidates clustered by entity and sorted inside files, so that their statistics prune; an atomic replacement."""
    rows = candidates.repartition(files, "video_uid") if files else candidates.repartition("video_uid")
    rows.sortWithinPartitions("video_uid", "cs", "ce").write.mode("overwrite").parquet(path)


def write_bucketed(candidates: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed by entity: later joins and windows by entity need no shuffle."""
    candidates.write.mode("overwrite").bucketBy(buckets, "video_uid").sortBy("video_uid", "cs").saveAsTable(table)


def append_ledger(used: DataFrame, path: str) -> None:
    """Usage marks are appended, never updated; a reset is an empty ledger."""
    used.select("id").write.mode("append").parquet(path)


def reset_ledger(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "id long").write.mode("overwrite").parquet(path)


def unused(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    return candidates.join(ledger.select("id").distinct(), "id", "left_anti")


def write_json_lines(rows: DataFrame, path: str, mode: str = "append", gzip: bool = False) -> None:
    rows.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per number in ``shard``, replaced as a whole."""
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def write_named_lines(rows: DataFrame, folder: str) -> None:
    """Rows (out, line) as lines of the files that ``out`` names."""
    named.register(rows.sparkSession)
    rows.repartition("out").sortWithinPartitions("out", "line").select("out", "line").write.format("named_lines").mode("append").save(folder)


def write_document(rows: DataFrame, path: str, key: str = "videos") -> None:
    """One JSON object with all rows under ``key``, of any number, as the one file of a folder: tasks write the rows' objects in parts, and one streams the parts together."""
    spark, parts = rows.sparkSession, scratch(rows.sparkSession, "parts")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.option("lineSep", ",").option("compression", "none").text(parts)
    system, own = located(path)
    system.delete_dir_contents(own, missing_dir_ok=True)
    exports.join_parts(spark, parts, f"{path.rstrip('/')}/part-00000.json", head=f"{{{json.dumps(key)}:[", tail="]}", separator=",")


def write_audit(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_uid_list(rows: DataFrame, path: str, key: str = "video_uid") -> None:
    rows.select(F.col(key).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def run_metadata(spark: SparkSession, **facts: object) -> DataFrame:
    """One row of configuration and counts."""
    return spark.createDataFrame([{k: str(v) for k, v in sorted(facts.items())}])
