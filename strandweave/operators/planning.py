"""Quota plans: joint counts, apportionment, inflation, the next target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DURATION_EDGES, PlanConfig
from ..functions.intervals import bucket_hi, bucket_lo


def with_buckets(rows: DataFrame, duration: str) -> DataFrame:
    return rows.withColumn("bucket_lo", bucket_lo(F.col(duration))).withColumn("bucket_hi", bucket_hi(F.col(duration)))


def joint_counts(rows: DataFrame, template: str | None) -> DataFrame:
    """Rows per (template, bucket), or per bucket."""
    return rows.groupBy(*([template] if template else []), "bucket_lo", "bucket_hi").agg(F.count("*").alias("n"))


def both_levels(rows: DataFrame, template: str) -> DataFrame:
    """Counts per (template, bucket) and per bucket in one pass; template is null and level 1 for the latter."""
    found = rows.groupingSets([[F.col(template), F.col("bucket_lo")], [F.col("bucket_lo")]], F.col(template), F.col("bucket_lo"))
    return found.agg(F.grouping(template).cast("int").alias("level"), F.count("*").alias("n"))


def apportioned(counts: DataFrame, keys: list[str], total: int, weight: str = "n") -> DataFrame:
    """Adds ``target``: floor of the share of ``total``, the rest to the largest fractions, ties by key.

    The table of cells is small by nature: one row per key.
    """
    share = counts.withColumn("share_", F.col(weight) * F.lit(float(total)) / F.sum(weight).over(Window.partitionBy()))
    share = share.withColumn("floor_", F.floor("share_")).withColumn("rest_", F.lit(total) - F.sum("floor_").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy().orderBy((F.col("share_") - F.col("floor_")).desc(), *keys))
    return share.withColumn("target", (F.col("floor_") + (rank <= F.col("rest_")).cast("long")).cast("long")).drop("share_", "floor_", "rest_")


def inflated(plan: DataFrame, config: PlanConfig = PlanConfig()) -> DataFrame:
    """Adds ``planned``: the target over the bucket's acceptance (kept within 0.001 and 1), times the safety factor, rounded up."""
    rate = F.lit(1.0)
    for lo, p in zip(DURATION_EDGES, config.acceptance):
        rate = F.when(F.col("bucket_lo") == lo, F.lit(min(max(p, 1e-3), 1.0))).otherwise(rate)
    return plan.withColumn("planned", F.ceil(F.col("target") / rate * config.safety).cast("long"))


def next_target(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The cell with the most left to do, the first by key on ties."""
    left = plan.join(done.groupBy(*keys).agg(F.count("*").alias("placed")), keys, "left").withColumn("remaining", F.col("target") - F.coalesce("placed", F.lit(0)))
    return left.where("remaining > 0").orderBy(F.col("remaining").desc(), *keys).limit(1).select(*keys, "remaining")
