"""Window and sequence operators over narrations(video_uid, timestamp_sec, narration_uid, narration_text).

Rows of one entity are ordered by time, then uid.  All of these need the same
partitioning, by entity, so a plan that chains them shuffles once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MOST_NARRATIONS, WindowConfig
from ..functions.intervals import bucket_hi, bucket_lo
from .materialise import checkpoint

ORDER = ("timestamp_sec", "narration_uid")


def entity(*more: str) -> Window:
    return Window.partitionBy("video_uid", *more).orderBy(*ORDER)


def valid(narrations: DataFrame, falsy: bool = False) -> DataFrame:
    """Rows with a time; with ``falsy`` also without time 0 and empty text."""
    rows = narrations.where(F.col("timestamp_sec").isNotNull())
    return rows.where((F.col("timestamp_sec") != 0) & (F.length("narration_text") > 0)) if falsy else rows


def eligible(narrations: DataFrame, least: int = 2) -> DataFrame:
    """Rows of entities that have at least ``least`` of them."""
    many = narrations.groupBy("video_uid").count().where(F.col("count") >= least).select("video_uid")
    return narrations.join(many, "video_uid", "left_semi")


def islands(narrations: DataFrame, gap: float, keep_single: bool = False) -> DataFrame:
    """Adds ``island``: a new one begins where the gap to the row before is more than ``gap``; islands of one row go."""
    fresh = F.coalesce(F.col("timestamp_sec") - F.lag("timestamp_sec").over(entity()) > gap, F.lit(True))
    rows = narrations.withColumn("island", F.sum(fresh.cast("int")).over(entity().rowsBetween(Window.unboundedPreceding, 0)))
    if keep_single:
        return rows
    return rows.withColumn("n_", F.count("*").over(Window.partitionBy("video_uid", "island"))).where("n_ > 1").drop("n_")


def with_unsure(narrations: DataFrame, tag: str) -> DataFrame:
    """Adds ``unsure``, from the text, unless the column is there."""
    if "unsure" in narrations.columns:
        return narrations
    return narrations.withColumn("unsure", F.coalesce(F.col("narration_text").contains(tag), F.lit(False)))


def _wide(rows: DataFrame, widths: tuple[int, ...], over: Window, sure_only: bool) -> DataFrame:
    """(video_uid, width, cs, ce, n): ``width`` rows from every row on, without unsure members."""
    line = F.col("timestamp_sec")
    options = [F.struct(F.lit(w).alias("width"), F.lead(line, w - 1).over(over).alias("ce"), F.max(F.col("unsure").cast("int")).over(over.rowsBetween(0, w - 1)).alias("bad")) for w in widths]
    # windows first, then the rows of each width
    out = rows.select("video_uid", line.alias("cs"), F.col("narration_uid").alias("first_uid"), F.array(*options).alias("all")).withColumn("w", F.explode("all"))
    out = out.select("video_uid", "first_uid", "cs", "w.ce", "w.width", "w.bad").where(F.col("ce").isNotNull())
    return out.where("bad = 0").drop("bad") if sure_only else out


def _with_bucket(windows: DataFrame) -> DataFrame:
    d = F.col("ce") - F.col("cs")
    return windows.withColumn("dur", d).withColumn("bucket_lo", bucket_lo(d)).withColumn("bucket_hi", bucket_hi(d))


def short_windows(narrations: DataFrame, config: WindowConfig = WindowConfig(), sure_only: bool = True) -> DataFrame:
    """Windows of two or three neighbouring rows, at most 4 s long."""
    rows = with_unsure(valid(narrations), config.unsure_tag)
    out = _with_bucket(_wide(rows, config.short_widths, entity(), sure_only))
    return out.where((F.col("dur") > config.least_duration) & (F.col("dur") <= config.short_longest))


def long_windows(narrations: DataFrame, config: WindowConfig = WindowConfig(), sure_only: bool = True) -> DataFrame:
    """Windows of 3 to 8 rows inside islands of gap 8, 4 s to under 60 s long."""
    rows = islands(with_unsure(valid(narrations), config.unsure_tag), config.long_gap_v1)
    out = _with_bucket(_wide(rows, config.long_widths, entity("island"), sure_only))
    return out.where((F.col("dur") >= config.short_longest) & (F.col("dur") < config.longest))


def _most(lo: Column) -> Column:
    cases = F.lit(None).cast("int")
    for (low, _), most in MOST_NARRATIONS.items():
        cases = F.when(lo == low, F.lit(most)).otherwise(cases)
    return cases


def _truncated(narrations: DataFrame, gap: float, widths: tuple[int, ...], least: float, config: WindowConfig, sure_only: bool, dedup: bool) -> DataFrame:
    rows = islands(with_unsure(valid(narrations), config.unsure_tag), gap)
    over = entity("island")
    reach = range(1, max(widths) + 1)
    times = F.array(*[F.lead("timestamp_sec", k - 1).over(over) for k in reach])
    bad = F.array(*[F.max(F.col("unsure").cast("int")).over(over.rowsBetween(0, k - 1)) for k in reach])
    out = rows.select("video_uid", F.col("narration_uid").alias("first_uid"), F.col("timestamp_sec").alias("cs"), times.alias("times"), bad.alias("bad"))
    out = out.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    full = F.get("times", F.col("width") - 1)
    out = out.withColumn("full", full - F.col("cs")).where((F.col("full") >= least) & (F.col("full") < config.longest))
    out = out.withColumn("width", F.least("width", F.coalesce(_most(bucket_lo(F.col("full"))), F.col("width"))))
    out = out.withColumn("ce", F.get("times", F.col("width") - 1))
    if sure_only:
        out = out.where(F.get("bad", F.col("width") - 1) == 0)
    out = _with_bucket(out.select("video_uid", "first_uid", "cs", "ce", "width"))
    return out.dropDuplicates(["video_uid", "first_uid", "cs", "ce"]) if dedup else out


def long_windows_v2(narrations: DataFrame, config: WindowConfig = WindowConfig(), sure_only: bool = True, dedup: bool = False) -> DataFrame:
    """Windows of 3 to 8 rows inside islands of gap 16, cut to their bucket's most rows; cuts can repeat a window."""
    return _truncated(narrations, config.long_gap_v2, config.long_widths, config.short_longest, config, sure_only, dedup)


def roll_windows_v2(narrations: DataFrame, config: WindowConfig = WindowConfig(), sure_only: bool = True) -> DataFrame:
    """Windows of 3 to 6 rows inside islands of gap 24, 32 s to under 60 s long."""
    return _truncated(narrations, config.roll_gap_v2, config.roll_widths_v2, 32.0, config, sure_only, False)


def rolling_windows(narrations: DataFrame, config: WindowConfig = WindowConfig(), sure_only: bool = True) -> DataFrame:
    """Fixed lengths from the first row on, in steps that grow with the entity's span; at least 4 rows each.

    The rows of a window come by an equality join on cells of the longest
    length, so the join's work follows rows times windows over them.
    """
    rows = with_unsure(valid(narrations), config.unsure_tag)
    span = rows.groupBy("video_uid").agg(F.min("timestamp_sec").alias("t0"), F.max("timestamp_sec").alias("t1"), F.count("*").alias("n")).where(F.col("n") >= config.roll_least)
    span = span.withColumn("span", F.col("t1") - F.col("t0")).where((F.col("span") > 0) & (F.col("span") <= config.roll_longest_video))
    adaptive = F.least(F.greatest(F.lit(config.roll_step), config.roll_fraction * F.col("span")), F.lit(2 * max(config.roll_lengths)))
    starts = span.withColumn("length", F.explode(F.array(*[F.lit(x) for x in config.roll_lengths]))).where(F.col("length") <= F.col("span") + config.eps)
    starts = starts.withColumn("step", F.greatest(F.lit(config.roll_step), F.least(adaptive, 0.5 * F.col("length"))))
    last = F.least(F.floor((F.col("span") - F.col("length") + config.eps) / F.col("step")), F.ceil(F.col("span") / F.col("step")) + 1).cast("int")
    starts = starts.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    rank = F.row_number().over(Window.partitionBy("video_uid").orderBy("length", "k"))
    starts = starts.withColumn("rank", rank).where(F.col("rank") <= config.roll_cap).withColumn("cs", F.col("t0") + F.col("k") * F.col("step"))
    windows = starts.select("video_uid", "length", "k", "cs", (F.col("cs") + F.col("length")).alias("ce"))
    cell = max(config.roll_lengths)
    cells = windows.withColumn("cell", F.explode(F.sequence(F.floor((F.col("cs") - config.eps) / cell), F.floor((F.col("ce") + config.eps) / cell))))
    inside = cells.join(rows.select("video_uid", "timestamp_sec", "unsure", F.floor(F.col("timestamp_sec") / cell).alias("cell")), ["video_uid", "cell"])
    inside = inside.where(F.col("timestamp_sec").between(F.col("cs") - config.eps, F.col("ce") + config.eps))
    out = inside.groupBy("video_uid", "length", "k", "cs", "ce").agg(F.count("*").alias("width"), F.max(F.col("unsure").cast("int")).alias("bad")).where(F.col("width") >= config.roll_least)
    return (out.where("bad = 0") if sure_only else out).drop("bad")


def counts_around(narrations: DataFrame, before: float, after: float) -> DataFrame:
    """Adds ``n_around``: rows of the entity in [t - before, t + after], by a value range frame."""
    frame = f"RANGE BETWEEN {float(before)}D PRECEDING AND {float(after)}D FOLLOWING"
    return narrations.withColumn("n_around", F.expr(f"count(*) OVER (PARTITION BY video_uid ORDER BY timestamp_sec {frame})"))


def without_consecutive(rows: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows whose value differs from the row before."""
    over = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("before_", F.lag(value).over(over)).withColumn("first_", F.row_number().over(over) == 1).where(F.col("first_") | ~F.col(value).eqNullSafe(F.col("before_"))).drop("before_", "first_")


def running_sums(rows: DataFrame, columns: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Adds run_<column> and all_<column>: sums up to each row in order, and of its whole group.

    Rows are dealt out by ranges of the order; sums run inside a range and start
    from what the ranges before it hold, so no group is sorted in one task.
    """
    parts = checkpoint(rows.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()))
    keys = [f"key_{i}" for i in range(len(by))]
    sums = parts.groupBy("part_", *by).agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    before, whole = Window.partitionBy(*by).orderBy("at_"), Window.partitionBy(*by)
    offsets = sums.withColumnRenamed("part_", "at_").select("at_", *[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], *[(F.sum(f"s_{c}").over(before) - F.col(f"s_{c}")).alias(f"before_{c}") for c in columns], *[F.sum(f"s_{c}").over(whole).alias(f"all_{c}") for c in columns])
    same = F.col("part_") == F.col("at_")
    for k, c in zip(keys, by, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(c))
    inside = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = parts.join(offsets, same)
    return met.select(*rows.columns, *[(F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in columns], *[f"all_{c}" for c in columns])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the rows' numbers in order, from 0 on and without gaps."""
    placed = running_sums(rows.withColumn("one_", F.lit(1)), ["one_"], order, [])
    return placed.withColumn(name, F.col("run_one_") - 1).drop("one_", "run_one_", "all_one_")


def ecdf(rows: DataFrame, value: str, partition: list[str] | None = None) -> DataFrame:
    """Adds ``ecdf``: place in order over the number of rows, ties apart."""
    by = partition or []
    order = [value, *[c for c in rows.columns if c != value and c not in by]]
    placed = running_sums(rows.withColumn("one_", F.lit(1)), ["one_"], order, by)
    return placed.withColumn("ecdf", F.col("run_one_") / F.col("all_one_")).drop("one_", "run_one_", "all_one_")


def candidates(parts: list[DataFrame]) -> DataFrame:
    """Union of catalogues as a bag, with ids by a total order."""
    columns = ["video_uid", "cs", "ce", "width", "dur", "bucket_lo", "bucket_hi"]
    bag = functools.reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    # a stable id without a global sort: a key of the interval and its number among equal ones
    same = Window.partitionBy("video_uid", "cs", "ce").orderBy("width", "dur")
    return bag.withColumn("copy", F.row_number().over(same)).withColumn("id", F.xxhash64("video_uid", "cs", "ce", "copy"))
