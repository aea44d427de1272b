"""Command line of the curation steps.

    python -m strandweave catalog --narrations FILE --split FILE --out FOLDER [--geom-only]
    python -m strandweave convert --dir FOLDER [--pattern P] [--recursive] [--output-dir FOLDER]
    python -m strandweave allocate --catalog FOLDER --narrations FILE --annotations FILE --out FOLDER [--templates FOLDER] [--total N] [--geom-only]
    python -m strandweave clean --input PATH --out FOLDER [--shard-rows N]
    python -m strandweave generate --input PATH --out FOLDER
    python -m strandweave merge --input PATH --out FOLDER [--per-window N]
    python -m strandweave export --input PATH --out FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CleanConfig, MergeConfig, PlanConfig
from .functions.intervals import clip_coordinates, inside_clip, relative_position
from .operators import cleaning, generation, joins, merge, planning, windows
from .operators.allocate import allocate
from .schemas import FLAT_RECORD, QUESTION
from .sources import files, json_files, sinks


def build_catalog(spark: SparkSession, narrations: str, splits: list[str], out: str, geom_only: bool) -> None:
    rows = json_files.narration_file(spark, narrations)
    for path in splits:
        rows = joins.without(rows, json_files.split_uids(spark, path))
    parts = [make(rows, sure_only=not geom_only) for make in (windows.short_windows, windows.long_windows_v2, windows.roll_windows_v2)]
    sinks.write_catalog(joins.containment_counts(windows.candidates(parts)), out)


def references(spark: SparkSession, annotations: str) -> DataFrame:
    """Annotated queries with their place in their clips: (ref_id, template, bucket_lo, bucket_hi, d, qs_rel, d_rel, clen)."""
    rows = json_files.annotation_file(spark, annotations)
    ends = clip_coordinates(F.col("clip_start_sec"), F.col("clip_end_sec"), F.col("video_start_sec"), F.col("video_end_sec"), F.col("clip_video_start"), F.col("clip_lo"))
    rows = rows.withColumn("q", ends).where(inside_clip(F.col("clip_lo"), F.col("clip_hi"), F.col("q.s"), F.col("q.e")))
    rows = rows.withColumn("r", relative_position(F.col("clip_lo"), F.col("clip_hi"), F.col("q.s"), F.col("q.e"))).withColumn("d", F.col("q.e") - F.col("q.s"))
    rows = planning.with_buckets(rows, "d").withColumn("clen", F.col("clip_hi") - F.col("clip_lo"))
    return rows.select(F.xxhash64("video_uid", "clip_lo", "clip_hi", "q.s", "q.e", "template").alias("ref_id"), F.coalesce("template", F.lit("")).alias("template"), "bucket_lo", "bucket_hi", "d", "r.qs_rel", "r.d_rel", "clen").dropDuplicates(["ref_id"])


def build_allocation(spark: SparkSession, catalog: str, narrations: str, annotations: str, out: str, templates: str | None, total: int, geom_only: bool) -> None:
    refs = references(spark, annotations)
    events = spark.read.parquet(catalog).select(F.col("id").alias("event_id"), "video_uid", "cs", "ce", "bucket_lo")
    if not geom_only:
        links = spark.read.parquet(templates).select(F.col("candidate_id").alias("event_id"), F.col("template_name").alias("template"))
        events = events.join(links, "event_id")
    ends = json_files.narration_file(spark, narrations).groupBy("video_uid").agg((F.coalesce(F.max("timestamp_sec"), F.lit(0.0)) + PlanConfig().end_buffer).alias("max_ts"))
    plan = planning.apportioned(planning.joint_counts(refs, "template"), ["template", "bucket_lo"], total)
    plan = planning.inflated(plan).select("template", "bucket_lo", F.col("planned").alias("target"))
    allocate(refs.drop("bucket_hi"), events, ends, plan, geom_only=geom_only).write.mode("overwrite").parquet(out)


def clean(spark: SparkSession, path: str, out: str, shard_rows: int) -> None:
    rows = cleaning.cleaned(json_files.typed(json_files.robust_records(spark, path), FLAT_RECORD))
    good = rows.where("reason = 'ok'").drop("reason")
    order = ["video_uid", "clip_start_sec", "clip_end_sec", "query_start_sec", "query_end_sec", "matched_template", "context_text"]
    sinks.write_shards(cleaning.sharded(good, order, CleanConfig(shard_rows=shard_rows)), out)
    for r in cleaning.reason_counts(rows).orderBy(F.desc("n"), "reason").collect():
        print(f"{r.n}\t{r.reason}")


def generate(spark: SparkSession, path: str, out: str) -> None:
    """One question per flat record; those that pass go to ``questions``, the audit to ``audit``."""
    records = spark.read.schema(FLAT_RECORD).option("recursiveFileLookup", "true").json(path)
    keyed = records.withColumn("key", F.xxhash64(*[c for c in records.columns if c != "narrations"]))
    asked = generation.questions(generation.window_lines(keyed), "key").withColumn("template", F.col("matched_template")).withColumn("source_narrations", F.col("lines"))
    good = asked.where("reason = 'ok'").select(*QUESTION.fieldNames())
    sinks.write_json_lines(merge.first_triplets(good.withColumn("k", F.xxhash64(*good.columns)), ["video_uid", "template", "query"], "k").drop("k"), f"{out}/questions")
    sinks.write_audit(asked, ["video_uid", "template", "query", "reason"], f"{out}/audit")


def merge_questions(spark: SparkSession, path: str, out: str, per_window: int) -> None:
    rows = spark.read.schema(QUESTION).option("recursiveFileLookup", "true").json(path)
    keyed = rows.withColumn("arrival", F.xxhash64(*rows.columns))
    kept = merge.best_per_window(keyed, "arrival") if per_window == 1 else merge.top_per_window(keyed, per_window, "arrival")
    sinks.write_json_lines(kept.select(*rows.columns), out, "overwrite")


def export(spark: SparkSession, path: str, out: str) -> None:
    """The nested tree, one video a line."""
    rows = spark.read.schema(QUESTION).option("recursiveFileLookup", "true").json(path)
    rows = rows.withColumn("arrival", F.xxhash64(*rows.columns)).withColumn("video_start_sec", F.col("query_start_sec")).withColumn("video_end_sec", F.col("query_end_sec"))
    sinks.write_json_lines(merge.nested(rows, "arrival"), out, "overwrite")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandweave")
    commands = parser.add_subparsers(dest="command", required=True)
    catalog = commands.add_parser("catalog")
    catalog.add_argument("--narrations", required=True)
    catalog.add_argument("--split", action="append", default=[])
    catalog.add_argument("--out", required=True)
    catalog.add_argument("--geom-only", action="store_true", help="keep windows whatever their texts say")
    convert = commands.add_parser("convert")
    convert.add_argument("--dir", required=True)
    convert.add_argument("--pattern", default="*.jsonl")
    convert.add_argument("--recursive", action="store_true")
    convert.add_argument("--output-dir")
    place = commands.add_parser("allocate")
    for name in ("--catalog", "--narrations", "--annotations", "--out"):
        place.add_argument(name, required=True)
    place.add_argument("--templates", help="links of candidates and templates; without them --geom-only")
    place.add_argument("--total", type=int, default=PlanConfig().final_target)
    place.add_argument("--geom-only", action="store_true", help="plan and match by duration alone")
    for name in ("clean", "generate", "merge", "export"):
        step = commands.add_parser(name)
        step.add_argument("--input", required=True)
        step.add_argument("--out", required=True)
        if name == "clean":
            step.add_argument("--shard-rows", type=int, default=CleanConfig().shard_rows)
        if name == "merge":
            step.add_argument("--per-window", type=int, default=MergeConfig().per_window)
    chosen = parser.parse_args(arguments)
    if chosen.command == "allocate" and not (chosen.templates or chosen.geom_only):
        parser.error("allocate needs --templates or --geom-only")
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    if chosen.command == "catalog":
        build_catalog(spark, chosen.narrations, chosen.split, chosen.out, chosen.geom_only)
    elif chosen.command == "convert":
        written, bad = files.convert_folder(spark, chosen.dir, chosen.pattern, chosen.recursive, chosen.output_dir)
        for row in written.orderBy("out").toLocalIterator():
            print(row.out)
        for row in bad.orderBy("file", "line_no").toLocalIterator():
            print(f"not JSON: {row.file}, line {row.line_no}", file=sys.stderr)
    elif chosen.command == "allocate":
        build_allocation(spark, chosen.catalog, chosen.narrations, chosen.annotations, chosen.out, chosen.templates, chosen.total, chosen.geom_only)
    elif chosen.command == "clean":
        clean(spark, chosen.input, chosen.out, chosen.shard_rows)
    elif chosen.command == "merge":
        merge_questions(spark, chosen.input, chosen.out, chosen.per_window)
    else:
        {"generate": generate, "export": export}[chosen.command](spark, chosen.input, chosen.out)


if __name__ == "__main__":
    main()
