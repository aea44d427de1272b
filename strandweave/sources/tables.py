"""Adapters: tables of a generic warehouse as narrations, queries and questions.

Times are hours since the epoch, so the interval constants keep their meaning
on event streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 3.6e9D")


def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (video_uid, timestamp_sec, narration_uid, narration_text, unsure, template, d)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_uid"), hours("ts").alias("timestamp_sec"), F.col("event_id").alias("narration_uid"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("narration_text"), (kind == "error").alias("unsure"), kind.alias("template"), F.col("value").alias("d"),
    )
