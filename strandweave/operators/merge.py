"""Merging shards of generated questions: deduplication, matching, nesting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PlanConfig
from ..functions.intervals import annotation_uid, clip_uid, milli, query_uid

WINDOW = ("video_uid", "clip_start_sec", "clip_end_sec", "query_start_sec", "query_end_sec")


def window_key(rows: DataFrame) -> DataFrame:
    """Adds k0..k4: the entity and the four ends to three digits; rows that lack any of them go."""
    keyed = rows.select("*", F.col("video_uid").alias("k0"), *[milli(F.col(c).try_cast("double")).alias(f"k{i}") for i, c in enumerate(WINDOW[1:], 1)])
    return keyed.where("k0 <> '' AND k1 IS NOT NULL AND k2 IS NOT NULL AND k3 IS NOT NULL AND k4 IS NOT NULL")


def best_per_window(rows: DataFrame, arrival: str, score: str | None = None) -> DataFrame:
    """One row per window: highest score (if given), else longest text, else first arrival."""
    keys = [f"k{i}" for i in range(5)]
    order = ([F.col(score).desc_nulls_last()] if score else []) + [F.length(F.coalesce("query", F.lit(""))).desc(), F.col(arrival)]
    keyed = window_key(rows)
    return keyed.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_", *keys)


def top_per_window(rows: DataFrame, n: int, arrival: str, score: str | None = None) -> DataFrame:
    """Up to ``n`` different (template, text) of a window, by score, then length, then arrival."""
    keys = [f"k{i}" for i in range(5)]
    text = F.trim(F.coalesce("query", F.lit("")))
    keyed = window_key(rows).withColumn("t_", F.coalesce("template", F.lit(""))).withColumn("q_", text)
    first = keyed.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys, "t_", "q_").orderBy(arrival))).where("rank_ = 1")
    value = F.coalesce(F.col(score), F.lit(0.0)) if score else F.lit(0.0)
    order = [value.desc(), F.length(F.coalesce("query", F.lit(""))).desc(), F.col(arrival)]
    return first.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_", "t_", "q_", *keys)


def first_triplets(rows: DataFrame, keys: list[str], arrival: str, seen: DataFrame | None = None) -> DataFrame:
    """The first row of each key that ``seen`` doesn't have."""
    from .joins import null_safe_anti

    first = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))).where("rank_ = 1").drop("rank_")
    return first if seen is None else null_safe_anti(first, seen, keys)


def merged_segments(segments: Column, tol: float = 0.05) -> Column:
    """Segments (s, e), sorted, each averaged into the last kept one if both ends are within ``tol`` of it."""
    kind = "array<struct<s:double,e:double>>"

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        near = (F.size(done) > 0) & (F.abs(last["s"] - x["s"]) <= tol) & (F.abs(last["e"] - x["e"]) <= tol)
        merged = F.struct(((last["s"] + x["s"]) / 2).alias("s"), ((last["e"] + x["e"]) / 2).alias("e"))
        return F.when(near, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    return F.aggregate(F.array_sort(segments), F.array().cast(kind), step)


def merge_segments(rows: DataFrame, by: list[str], start: str = "s", end: str = "e", tol: float = PlanConfig().segment_tolerance) -> DataFrame:
    """(by, seg, s, e): merged_segments() of each group, numbered; linear in the group, one pass over its sorted ends."""
    fields = rows.select(*by).schema

    def fold(table: pa.Table) -> pa.Table:
        s, e = (table.column(c).to_numpy() for c in (start, end))
        order = np.lexsort((e, s))
        out: list[list[float]] = []
        for a, b in zip(s[order].tolist(), e[order].tolist(), strict=True):
            if out and abs(out[-1][0] - a) <= tol and abs(out[-1][1] - b) <= tol:
                out[-1] = [(out[-1][0] + a) / 2, (out[-1][1] + b) / 2]
            else:
                out.append([a, b])
        own = {c: pa.array([table.column(c)[0].as_py()] * len(out), table.schema.field(c).type) for c in by}
        return pa.table({**own, "seg": pa.array(range(len(out)), pa.int32()), "s": pa.array([x for x, _ in out], pa.float64()), "e": pa.array([x for _, x in out], pa.float64())})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ends = rows.select(*by, F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end)).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return ends.groupBy(*by).applyInArrow(fold, f"{kind}, seg int, s double, e double")


def context_text(rows: DataFrame, clip: list[str]) -> DataFrame:
    """(clip, context_text, n): narrations once each by uid, else by text, in time order, joined."""
    name = F.coalesce(F.col("narration_uid").cast("string"), F.col("narration_text"))
    first = rows.withColumn("name_", name).withColumn("rank_", F.row_number().over(Window.partitionBy(*clip, "name_").orderBy("timestamp_sec"))).where("rank_ = 1")
    line = F.array_sort(F.collect_list(F.struct("timestamp_sec", "name_", "narration_text")))
    return first.groupBy(*clip).agg(F.array_join(F.transform(line, lambda x: x["narration_text"]), " ").alias("context_text"), F.count("*").alias("n"))


def derived_ids(rows: DataFrame, arrival: str) -> DataFrame:
    """Adds clip_uid, annotation_uid and query_id: clips are numbered per entity and queries per clip, by first arrival."""
    clip = ["video_uid", "clip_start_sec", "clip_end_sec"]
    ends = rows.withColumn("lo_", F.least("clip_start_sec", "clip_end_sec")).withColumn("hi_", F.greatest("clip_start_sec", "clip_end_sec"))
    ends = ends.where("video_uid <> '' AND lo_ IS NOT NULL").withColumn("clip_start_sec", F.col("lo_")).withColumn("clip_end_sec", F.col("hi_")).drop("lo_", "hi_")
    clips = ends.groupBy(*clip).agg(F.min(arrival).alias("arrival_"))
    clips = clips.withColumn("clip_idx", F.row_number().over(Window.partitionBy("video_uid").orderBy("arrival_")) - 1)
    out = ends.withColumn("query_idx", F.row_number().over(Window.partitionBy(*clip).orderBy(arrival)) - 1).join(clips.drop("arrival_"), clip)
    out = out.withColumn("clip_uid", clip_uid(F.col("video_uid"), F.col("clip_start_sec"), F.col("clip_end_sec"), F.col("clip_idx")))
    return out.withColumn("annotation_uid", annotation_uid(F.col("clip_uid"))).withColumn("query_id", query_uid(F.col("video_uid"), F.col("clip_uid"), F.col("query_idx")))


def nested(rows: DataFrame, arrival: str) -> DataFrame:
    """(video_uid, clips): the export tree of questions that have a text; rows need video_start_sec and video_end_sec."""
    ids = derived_ids(rows, arrival).where(F.length(F.trim(F.coalesce("query", F.lit("")))) > 0)
    question = F.struct("query_idx", F.trim("query").alias("query"), "template", "clip_start_sec", "clip_end_sec", "video_start_sec", "video_end_sec", "query_id")
    clips = ids.groupBy("video_uid", "clip_idx", "clip_uid", "annotation_uid", "clip_start_sec", "clip_end_sec").agg(F.array_sort(F.collect_list(question)).alias("language_queries"))
    clip = F.struct("clip_idx", "clip_uid", "clip_start_sec", "clip_end_sec", F.col("clip_start_sec").alias("video_start_sec"), F.col("clip_end_sec").alias("video_end_sec"), F.array(F.struct("annotation_uid", "language_queries")).alias("annotations"))
    return clips.groupBy("video_uid").agg(F.array_sort(F.collect_list(clip)).alias("clips"))


def first_by_segment(rows: DataFrame, value: str, order: str, start: str = "s", end: str = "e") -> DataFrame:
    """(start_key, end_key, value): the first value of each segment, its ends to three digits."""
    keyed = rows.select(milli(F.col(start)).alias("start_key"), milli(F.col(end)).alias("end_key"), value, order)
    return keyed.groupBy("start_key", "end_key").agg(F.min_by(value, order).alias(value))
