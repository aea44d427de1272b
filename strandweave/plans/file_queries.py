"""Queries through files and streams: sinks write the tables' rows, sources read them back.

Files go to new paths in the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import bucket_lo
from ..operators.materialise import scratch
from ..schemas import QUESTION
from ..sources import exports, files, json_files, json_scan, matrices, sinks
from ..sources.batches import Batches, append_catalog
from ..sources.tables import hours, narrations, table
from ..streaming import appends, streams
from .base import N, bucket_sql, query


def _text_file(rows: DataFrame, value, name: str, gzip: bool = False) -> str:
    """The rows' texts as lines under a new path."""
    path = scratch(rows.sparkSession, name)
    rows.select(value.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)
    return path


# ---- sources

@query(f"WITH {N} SELECT video_uid::VARCHAR AS video_uid, count(*) AS n, min(uid::VARCHAR) AS first_uid, round(max(t), 6) AS total, min(txt) AS first_text FROM n GROUP BY video_uid")
def scan_narrations(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct(F.col("timestamp_sec"), F.col("narration_text"), F.col("narration_uid").cast("string").alias("narration_uid"))
    entity = narrations(spark, d).groupBy(F.col("video_uid").cast("string").alias("video_uid")).agg(F.struct(F.struct(F.collect_list(line).alias("narrations")).alias("narration_pass_1")).alias("v"))
    path = _text_file(entity, F.to_json(F.create_map("video_uid", "v")), "narrations")
    found = json_files.narration_file(spark, f"{path}/*.txt", lines=True)
    return found.groupBy("video_uid").agg(F.count("*").alias("n"), F.min("narration_uid").alias("first_uid"), F.round(F.max("timestamp_sec"), 6).alias("total"), F.min("narration_text").alias("first_text"))


_TREE = "q AS (SELECT user_id::VARCHAR AS video_uid, event_type AS template, value AS s, value + 1 AS e FROM events WHERE value IS NOT NULL)"


def _tree(spark: SparkSession, d: str) -> str:
    """One annotation tree a line: a video with one clip per event type."""
    q = table(spark, d, "events").where("value IS NOT NULL").select(F.col("user_id").cast("string").alias("video_uid"), F.col("event_type").alias("template"), F.col("value").alias("clip_start_sec"), (F.col("value") + 1).alias("clip_end_sec"))
    clips = q.groupBy("video_uid", "template").agg(F.min("clip_start_sec").alias("lo"), F.max("clip_end_sec").alias("hi"), F.collect_list(F.struct("template", "clip_start_sec", "clip_end_sec")).alias("language_queries"))
    clip = F.struct(F.col("lo").alias("clip_start_sec"), F.col("hi").alias("clip_end_sec"), F.lit(0.0).alias("video_start_sec"), F.array(F.struct("language_queries")).alias("annotations"))
    videos = clips.groupBy("video_uid").agg(F.collect_list(clip).alias("clips"))
    return _text_file(videos, F.to_json(F.struct(F.array(F.struct("video_uid", "clips")).alias("videos"))), "tree")


@query(f"WITH {_TREE} SELECT video_uid, template, min(s) OVER (PARTITION BY video_uid, template) AS clip_lo, max(e) OVER (PARTITION BY video_uid, template) AS clip_hi, s, e FROM q")
def scan_annotations(spark: SparkSession, d: str) -> DataFrame:
    found = json_files.annotation_file(spark, _tree(spark, d), lines=True)
    return found.select("video_uid", "template", "clip_lo", "clip_hi", F.col("clip_start_sec").alias("s"), F.col("clip_end_sec").alias("e"))


@query("SELECT DISTINCT user_id::VARCHAR AS video_uid FROM events WHERE value IS NOT NULL")
def scan_split(spark: SparkSession, d: str) -> DataFrame:
    return json_files.split_uids(spark, _tree(spark, d), lines=True)


_DIRTY = "c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 1 THEN NULL ELSE c_acctbal END AS x FROM customer WHERE c_custkey % 5 <> 3)"


def _dirty(spark: SparkSession, d: str, gzip: bool = False) -> str:
    """JSON lines: sound, with NaN, with a trailing comma, hopeless, with a control character."""
    k, x = F.col("c_custkey"), F.to_json(F.struct(F.col("c_acctbal").alias("x")))
    number = F.regexp_extract(x, r":(.*)\}", 1)
    line = F.when(k % 5 == 1, F.format_string('{"k": %d, "x": NaN}', k)).when(k % 5 == 2, F.format_string('{"k": %d, "x": %s,}', k, number)).when(k % 5 == 3, F.format_string('{"k": %d, broken', k)).when(k % 5 == 4, F.format_string('{"k": %d, "x": %s}\x07', k, number)).otherwise(F.format_string('{"k": %d, "x": %s}', k, number))
    return _text_file(table(spark, d, "customer"), line, "dirty", gzip)


@query(f"WITH {_DIRTY} SELECT k, x FROM c")
def read_robust(spark: SparkSession, d: str) -> DataFrame:
    return json_files.typed(json_files.robust_lines(spark, _dirty(spark, d)), "k BIGINT, x DOUBLE")


@query(f"WITH {_DIRTY} SELECT k, x FROM c")
def read_robust_gzip(spark: SparkSession, d: str) -> DataFrame:
    return json_files.typed(json_files.robust_lines(spark, _dirty(spark, d, gzip=True)), "k BIGINT, x DOUBLE")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("video_uid"), F.col("event_type").alias("template"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("query"), F.col("value").alias("clip_start_sec"), F.col("event_id").cast("double").alias("query_start_sec"))


@query("SELECT user_id::VARCHAR AS video_uid, event_type AS template, event_type || ' ' || props AS query, value AS clip_start_sec, event_id::DOUBLE AS query_start_sec FROM events")
def read_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "lines")
    sinks.write_json_lines(_questions(spark, d), path, gzip=True)
    return json_files.json_lines(spark, path, QUESTION)[0].select("video_uid", "template", "query", "clip_start_sec", "query_start_sec")


@query("SELECT DISTINCT user_id::VARCHAR AS video_uid FROM events")
def read_uids(spark: SparkSession, d: str) -> DataFrame:
    uid = F.col("user_id").cast("string")
    keys = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(uid.alias("video_uid")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(uid.alias("videoId")))).otherwise(F.to_json(F.struct(uid.alias("uid"))))
    return json_files.uids(json_files.robust_lines(spark, _text_file(table(spark, d, "events"), keys, "uids")))


@query("WITH s AS (SELECT ((row_number() OVER (ORDER BY event_id) - 1) // 300)::BIGINT AS shard FROM events) SELECT shard, count(*) AS n FROM s GROUP BY shard")
def shard_files(spark: SparkSession, d: str) -> DataFrame:
    from ..config import CleanConfig
    from ..operators.cleaning import sharded

    path = scratch(spark, "shards")
    sinks.write_shards(sharded(table(spark, d, "events"), ["event_id"], CleanConfig(shard_rows=300)), path)
    lines = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path)
    return lines.groupBy(F.regexp_extract("_metadata.file_path", r"shard=(\d+)", 1).cast("long").alias("shard")).agg(F.count("*").alias("n"))


def _records(spark: SparkSession, d: str, name: str):
    """A folder with the events as one array a file, as a wrapped array, and as lines with broken ones."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    path = scratch(spark, name)
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "props"))
    whole = e.where("event_id % 3 < 2").groupBy((F.col("event_id") % 3).alias("k"), F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("p")).agg(F.array_join(F.collect_list(record), " ,\n ").alias("all"))
    text = F.when(F.col("k") == 0, F.concat(F.lit("[\n"), "all", F.lit("\n]\n"))).otherwise(F.concat(F.lit('{"meta": {"a": [1, "]"]}, "items": ['), "all", F.lit("]}")))
    whole.repartition(8, "k", "p").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    broken = F.when(F.col("event_id") % 2 == 0, record).otherwise(F.concat(F.lit("{"), record))
    e.where("event_id % 3 = 2").select(broken.alias("value")).write.mode("append").text(path)
    return path


_KEPT_RECORDS = "SELECT event_id, user_id, event_type, props FROM events WHERE event_id % 3 < 2 OR event_id % 2 = 0"


@query(_KEPT_RECORDS)
def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Arrays, wrapped arrays and broken lines, each file as it is."""
    return json_files.typed(json_files.robust_records(spark, _records(spark, d, "robust")), "event_id BIGINT, user_id BIGINT, event_type STRING, props STRING")


@query("SELECT event_id, user_id, event_type, props FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 2 AND event_id % 2 = 0)")
def read_array_or_lines(spark: SparkSession, d: str) -> DataFrame:
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING, props STRING"
    rows = json_files.array_or_lines(spark, _records(spark, d, "arrays"), spark.createDataFrame([], schema).schema)
    return rows.where("event_id IS NOT NULL")  # a wrapped array is one record of another shape


@query(f"WITH {N} SELECT video_uid::VARCHAR AS video_uid, count(*) AS n, min(uid::VARCHAR) AS first_uid, round(max(t), 6) AS last FROM n GROUP BY video_uid")
def scan_narration_document(spark: SparkSession, d: str) -> DataFrame:
    """The narrations as few objects keyed by video, each a document."""
    line = F.struct(F.col("timestamp_sec"), F.col("narration_text"), F.col("narration_uid").cast("string").alias("narration_uid"))
    entity = narrations(spark, d).groupBy(F.col("video_uid").cast("string").alias("video_uid")).agg(F.to_json(F.struct(F.struct(F.collect_list(line).alias("narrations")).alias("narration_pass_1"))).alias("v"))
    member = F.concat(F.to_json(F.array("video_uid")).substr(F.lit(2), F.length(F.to_json(F.array("video_uid"))) - 2), F.lit(": "), "v")
    whole = entity.groupBy(F.pmod(F.xxhash64("video_uid"), F.lit(3)).alias("k")).agg(F.array_join(F.collect_list(member), ",\n").alias("all"))
    path = scratch(spark, "narration_document")
    whole.repartition(3, "k").select(F.concat(F.lit("{"), "all", F.lit("}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = json_files.narration_file(spark, path)
    return found.groupBy("video_uid").agg(F.count("*").alias("n"), F.min("narration_uid").alias("first_uid"), F.round(F.max("timestamp_sec"), 6).alias("last"))


@query(f"WITH {_TREE} SELECT 'tree' AS shape, video_uid, template, s AS clip_start_sec FROM q UNION ALL SELECT 'list', user_id::VARCHAR, event_type, value FROM events")
def flattened_files(spark: SparkSession, d: str) -> DataFrame:
    """The form of each file is found by its shape: an export tree or a flat list."""
    q = table(spark, d, "events")
    # one array of all questions in one row would not scale: an array file a few hundred of them
    record = F.to_json(F.struct(F.col("user_id").cast("string").alias("video_uid"), F.col("event_type").alias("template"), F.col("value").alias("clip_start_sec")))
    lists = q.groupBy(F.floor(F.col("event_id") / 500)).agg(F.array_join(F.collect_list(record), ",").alias("all"))
    flat = scratch(spark, "flat")
    lists.repartition(4).select(F.concat(F.lit("["), "all", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(flat)
    columns = ["video_uid", "template", "clip_start_sec"]
    out = []
    for shape, path in (("tree", _tree_documents(spark, d)), ("list", flat)):
        out.append(json_files.flattened_questions(spark, path).select(F.lit(shape).alias("shape"), *columns))
    return out[0].unionByName(out[1])


def _tree_documents(spark: SparkSession, d: str) -> str:
    """The lines of _tree() as documents, a file each of some of them."""
    videos = spark.read.text(_tree(spark, d)).select(F.regexp_extract("value", r'^\{"videos":\[(.*)\]\}$', 1).alias("v"))
    some = videos.groupBy(F.pmod(F.xxhash64("v"), F.lit(3)).alias("k")).agg(F.array_join(F.collect_list("v"), ", ").alias("all"))
    path = scratch(spark, "trees")
    some.repartition(3, "k").select(F.concat(F.lit('{"version": "1", "videos": ['), "all", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("""WITH s AS (SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 250)::INT AS shard FROM events), c AS (SELECT shard, count(*) AS n FROM s WHERE shard % 5 <> 2 GROUP BY shard)
SELECT shard, n, false AS missing FROM c UNION ALL SELECT DISTINCT shard, 0, true FROM s WHERE shard % 5 = 2""")
def shard_listing(spark: SparkSession, d: str) -> DataFrame:
    """Shard files of which some are gone: which there are with how many rows, and which are missing."""
    from ..operators.cleaning import sharded
    from ..config import CleanConfig

    path = scratch(spark, "listing")
    rows = sharded(table(spark, d, "events").select("event_id"), ["event_id"], CleanConfig(shard_rows=250))
    last = rows.agg(F.max("shard")).first()[0]
    name = F.concat(F.lit(path), F.format_string("/shard_%04d.jsonl", "shard"))
    kept = rows.where("shard % 5 <> 2").select(name.alias("out"), F.to_json(F.struct("event_id")).alias("line"))
    sinks.write_named_lines(kept, path)
    found = files.shards(spark, path)
    counts = files.shard_counts(spark, path).select(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("shard"), "n")
    there = found.join(counts, "shard").select("shard", "n", F.lit(False).alias("missing"))
    return there.unionByName(files.missing_shards(found, 0, last).select("shard", F.lit(0).cast("long").alias("n"), F.lit(True).alias("missing")))


@query("SELECT vec_id::VARCHAR AS video_uid FROM embeddings WHERE label IN (1, 4)")
def feature_probe(spark: SparkSession, d: str) -> DataFrame:
    """Feature files of some entities, found by their names."""
    path = scratch(spark, "features")
    rows = table(spark, d, "embeddings").where("label IN (1, 4)")
    sinks.write_named_lines(rows.select(F.concat(F.lit(f"{path}/"), F.col("vec_id").cast("string"), F.lit(".pt")).alias("out"), F.lit("x").alias("line")), path)
    return files.present_features(spark, path)


@query("SELECT vec_id AS key, round(list_sum(embedding)::DOUBLE, 4) AS total, len(embedding)::INT AS width FROM embeddings")
def matrix_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as one .npy file with the list of their keys, and read by row blocks."""
    path = f"{scratch(spark, 'matrix')}/vectors.npy"
    rows = table(spark, d, "embeddings")
    matrices.write_matrix(rows, path, "vec_id", "embedding")
    found = matrices.read_keyed(spark, path, 64)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("key", F.round(total, 4).alias("total"), F.size("vector").alias("width"))


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0")
def convert_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with broken ones, converted to arrays and read back."""
    e = table(spark, d, "events")
    folder = _text_file(e, F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id"))), "convert")
    out = scratch(spark, "converted")
    files.convert_folder(spark, folder, "*.txt", out_folder=out)
    parts = json_scan.parts(spark, out)[0]
    return parts.select(F.from_json("text", "event_id BIGINT").alias("x")).select("x.*")


# ---- sinks

@query(f"WITH {N} SELECT uid AS id, video_uid, t AS cs, t + d AS ce FROM n")
def write_catalogue(spark: SparkSession, d: str) -> DataFrame:
    n = narrations(spark, d)
    path = scratch(spark, "catalogue")
    sinks.write_catalog(n.select(F.col("narration_uid").alias("id"), "video_uid", F.col("timestamp_sec").alias("cs"), (F.col("timestamp_sec") + F.col("d")).alias("ce")), path)
    return spark.read.parquet(path)


@query("""WITH e AS (SELECT *, event_id % 4 AS part FROM events WHERE event_id % 4 <> 2), i AS (SELECT *, row_number() OVER (ORDER BY part, event_id) AS id FROM e)
SELECT id, event_id, event_type AS template_name FROM i UNION ALL SELECT id, event_id, 'all' FROM i WHERE value IS NOT NULL""")
def catalogue_batches(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and their templates in four batches, of which the third fails halfway and the fourth comes twice."""
    batches = Batches(spark, scratch(spark, "batches"))
    e = table(spark, d, "events")
    names = F.when(F.col("value").isNotNull(), F.array("event_type", F.lit("all"))).otherwise(F.array("event_type"))
    for part in (0, 1, 2, 3, 3):
        fails = F.raise_error("the batch breaks off").cast("string")
        own = names if part != 2 else F.transform(names, lambda x: F.when(x == "all", fails).otherwise(x))
        rows = e.where(F.col("event_id") % 4 == part).select("event_id", "user_id", own.alias("templates"))
        try:
            append_catalog(batches, rows, ["event_id"], writer="catalogue", batch=part)
        except SparkRuntimeException:
            if part != 2:
                raise
    links = batches.read("templates").withColumnRenamed("candidate_id", "id")
    return batches.read("candidates").select("id", "event_id").join(links, "id")


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ledger")
    ids = table(spark, d, "events").select(F.col("event_id").alias("id"))
    sinks.reset_ledger(spark, path)
    for k in (3, 5):
        sinks.append_ledger(ids.where(f"id % {k} = 0"), path)
    return sinks.unused(ids, spark.read.parquet(path))


@query("SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P'")
def write_documents(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "document")
    sinks.write_document(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p")), path)
    found = json_scan.parts(spark, path, ("videos",))[0].where("key = 'videos' AND trim(text) <> ''")
    return found.select(F.from_json("text", "k BIGINT, p STRING").alias("x")).select("x.*")


_ASKED = "m AS (SELECT user_id::VARCHAR AS video_uid, floor(value / 50) AS lo, value AS s, event_type AS template, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' what ' || event_type || '? ' END AS query FROM events WHERE value IS NOT NULL)"


@query(f"WITH {_ASKED} SELECT video_uid, lo AS clip_lo, lo + 8 AS clip_hi, template, trim(query) AS query, s, s + 1 AS e FROM m WHERE trim(query) <> ''")
def write_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested document written in parts, joined to one file and read back; a seventh of the questions is blank."""
    e, low = table(spark, d, "events").where("value IS NOT NULL"), F.floor(F.col("value") / 50).cast("double")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" what "), "event_type", F.lit("? ")))
    rows = e.select(F.col("event_id").alias("arrival"), F.col("user_id").cast("string").alias("video_uid"), low.alias("clip_start_sec"), (low + 8).alias("clip_end_sec"), F.col("value").alias("video_start_sec"), (F.col("value") + 1).alias("video_end_sec"), F.col("event_type").alias("template"), text.alias("query"))
    folder, out = scratch(spark, "nested"), f"{scratch(spark, 'joined')}/nested.json"
    exports.write_tree(rows, folder, "arrival")
    exports.join_parts(spark, folder, out)
    found = json_files.annotation_file(spark, out)
    return found.select("video_uid", "clip_lo", "clip_hi", "template", "query", F.col("video_start_sec").alias("s"), F.col("video_end_sec").alias("e"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_audit(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "audit")
    sinks.write_audit(table(spark, d, "customer"), ["c_custkey", "c_name", "c_acctbal"], path)
    return spark.read.schema("c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE").csv(path, header=True)


@query("SELECT c_custkey::VARCHAR AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def write_uids(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "uids")
    missing = table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    sinks.write_uid_list(missing, path, "c_custkey")
    return spark.read.text(path)


@query(f"SELECT 'events' AS name, count(*)::VARCHAR AS n_rows, count(DISTINCT {bucket_sql('value')})::VARCHAR AS n_buckets FROM events")
def run_facts(spark: SparkSession, d: str) -> DataFrame:
    n, buckets = table(spark, d, "events").agg(F.count("*"), F.countDistinct(bucket_lo(F.col("value")))).first()
    return sinks.run_metadata(spark, name="events", n_rows=n, n_buckets=buckets)


# ---- streams, run until what is there is done; a last row far ahead lets the watermark pass the others

FAR = "TIMESTAMP '2100-01-01 00:00:00'"


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    path, order = scratch(spark, "events"), ["event_id", "user_id", "event_type", "ts", "value"]
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*order)
    rows.repartition(4).write.parquet(path)
    # a file of its own, read last: the watermark then passes all others
    rows.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("ts", F.expr(FAR)).coalesce(1).write.mode("append").parquet(path)
    return streams.file_stream(spark, path, rows.schema)


def _finished(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """What a stream has written once it has read all there is."""
    out = scratch(spark, "stream")
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", scratch(spark, "marks")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"""WITH {N}, g AS (SELECT *, CASE WHEN t - lag(t) OVER o > 8 THEN 1 ELSE 0 END AS new FROM n WINDOW o AS (PARTITION BY video_uid ORDER BY t, uid)), i AS (SELECT video_uid, t, sum(new) OVER (PARTITION BY video_uid ORDER BY t, uid) AS island FROM g)
SELECT video_uid AS user_id, round(min(t), 6) AS start, round(max(t), 6) AS last, count(*) AS n FROM i GROUP BY video_uid, island HAVING count(*) > 1""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = _finished(streams.sessions(_events_stream(spark, d), "user_id", "ts", late="4000 days"), spark)
    at = lambda c: F.round(hours(f"CAST({c} AS TIMESTAMP_NTZ)"), 6).alias(c)
    return found.where("user_id >= 0").select("user_id", at("start"), at("last"), "n")


@query("""WITH w AS (SELECT user_id, unnest(range(0, 5)) AS k, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, (t // 28800000000 - k) * 8 AS start FROM w WHERE (t // 28800000000 - k) * 28800000000 + 129600000000 > t)
SELECT user_id, start::BIGINT AS start, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 4""")
def stream_rolling(spark: SparkSession, d: str) -> DataFrame:
    found = _finished(streams.rolling_counts(_events_stream(spark, d), "user_id", "ts", late="4000 days"), spark)
    return found.where("user_id >= 0").select("user_id", F.floor(F.unix_seconds("start") / 3600).alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_firsts(spark: SparkSession, d: str) -> DataFrame:
    found = _finished(streams.first_of_key(_events_stream(spark, d), ["user_id", "event_type"], "ts", late="40000 days"), spark)
    return found.where("user_id >= 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the same files, the second without the first one's checkpoint: nothing comes twice."""
    path, out = scratch(spark, "in"), scratch(spark, "out")
    rows = table(spark, d, "events").select("event_id", "event_type")
    rows.repartition(3).write.parquet(path)
    for _ in range(2):
        appends.append_new(streams.file_stream(spark, path, rows.schema), out, scratch(spark, "marks"), ["event_id"]).trigger(availableNow=True).start().awaitTermination()
    return appends.Appends(spark, out, ["event_id"]).table()


@query("SELECT user_id AS id, count(*) + CASE WHEN user_id % 2 = 0 THEN 10 ELSE 0 END AS uses, user_id % 2 = 1 AS new FROM events GROUP BY user_id")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Marks of entities in several micro-batches over a ledger that has half of them; the last count of each, and whether one of its marks was fresh."""
    path = scratch(spark, "marks_in")
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"))
    rows.repartition(3).write.parquet(path)
    ledger = rows.where("id % 2 = 0").distinct().withColumn("uses", F.lit(10).cast("long"))
    found = _finished(streams.usage_ledger(streams.file_stream(spark, path, rows.schema), "id", ledger), spark)
    return found.groupBy("id").agg(F.max("uses").alias("uses"), F.max("fresh").alias("new"))
