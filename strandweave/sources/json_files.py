"""JSON sources: known trees with schemas, and text of unknown shape through VARIANT.

Documents of any size are cut into their parts by a structural scan, in
parallel; a record must fit into a row, a document need not.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions.texts import repair_json
from ..operators.materialise import checkpoint
from ..schemas import ANNOTATION_FILE, LANGUAGE_QUERY, NARRATION_FILE
from .json_scan import parts

#: Keys under which a wrapper object keeps its records, in order (fixed values).
WRAPPER_KEYS = ("clips", "data", "rows", "items", "candidates")
UID_KEYS = ("video_uid", "videoId", "uid")


def narration_file(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of an object keyed by video uid, or with ``lines`` of one such object a line; a missing file raises."""
    if lines:
        raw = spark.read.text(path)
    else:
        raw = parts(spark, path)[0].where("top = '{'").select(F.concat(F.lit("{"), "text", F.lit("}")).alias("value"))
    videos = raw.select(F.explode(F.from_json("value", NARRATION_FILE)).alias("video_uid", "v"))
    return videos.select("video_uid", F.inline("v.narration_pass_1.narrations"))


def _videos(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(v) the videos of annotation trees, or with ``lines`` of one tree a line."""
    if lines:
        return spark.read.schema(ANNOTATION_FILE).json(path).select(F.explode("videos").alias("v"))
    video = ANNOTATION_FILE["videos"].dataType.elementType
    return parts(spark, path, ("videos",))[0].where("key = 'videos'").select(F.from_json("text", video).alias("v"))


def annotation_file(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(video_uid, clip..., query...) of an annotation tree, or with ``lines`` of one a line; empty lists give no rows."""
    clips = _videos(spark, path, lines).select("v.video_uid", F.explode("v.clips").alias("c"))
    notes = clips.select("video_uid", F.col("c.clip_start_sec").alias("clip_lo"), F.col("c.clip_end_sec").alias("clip_hi"), F.col("c.video_start_sec").alias("clip_video_start"), F.explode("c.annotations").alias("a"))
    return notes.select("video_uid", "clip_lo", "clip_hi", "clip_video_start", F.inline("a.language_queries"))


def split_uids(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(video_uid) of a split file; a missing file is an empty set, with a warning."""
    try:
        spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no split file at {path}: nothing is excluded", stacklevel=2)
        return spark.createDataFrame([], "video_uid string")
    return _videos(spark, path, lines).select("v.video_uid").where("video_uid IS NOT NULL").distinct()


#: Stands after a text that is tried as one value, so that no bracket of the text's own can end the list around it unseen.
_END = "strandweave: end of the text"


def whole_document(text: Column) -> Column:
    """VARIANT of a text that is one JSON value to its end, else null: a bare parse would ignore what follows the first value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    ended = F.try_variant_get(listed, "$[1]", "string").eqNullSafe(F.lit(_END)) & F.try_variant_get(listed, "$[2]", "variant").isNull()
    return F.when(ended, F.try_variant_get(listed, "$[0]", "variant"))


def parsed(text: Column) -> Column:
    """VARIANT of the text, or of its repaired form, or null."""
    return F.coalesce(whole_document(text), whole_document(repair_json(text)))


def _documents(spark: SparkSession, path: str, keys: tuple[str, ...], repair: bool) -> tuple[DataFrame, DataFrame]:
    """(records, files): (file, record VARIANT) of the files that are one JSON document, repaired if they must be, and those files' names.

    A list gives its elements; an object those of its first key in ``keys`` that
    holds a list, else itself, which is then one record in one row.
    """
    found, files = parts(spark, path, keys)
    member = F.col("top").eqNullSafe("{") & (F.col("key") == "")
    text = F.when(member, F.concat(F.lit("{"), "text", F.lit("}"))).otherwise(F.col("text"))
    blank = ~F.col("text").rlike(r"[^ \t\r\n\x00-\x1F]")
    tried = found.withColumn("raw", whole_document(text)).withColumn("fixed", whole_document(repair_json(text)) if repair else F.lit(None).cast("variant"))
    good = (F.col("raw").isNotNull() & ~blank) | (blank & F.col("opened") & F.col("closed"))
    mended = (F.col("fixed").isNotNull() & ~blank) | (blank & F.col("closed")) if repair else F.lit(False)
    # "[,]" is mended to an empty list
    each = tried.groupBy("file", "key").agg(F.min(good).alias("good"), (F.min(mended) | (F.lit(repair) & (F.count("*") == 2) & F.min(blank))).alias("mended"))
    of_key = [F.max(F.col("key") == k).alias(f"has_{i}") for i, k in enumerate(keys)]
    judged = each.groupBy("file").agg(F.min("good").alias("good"), F.min("mended").alias("mended"), *of_key)
    first = F.coalesce(*[F.when(F.col(f"has_{i}"), F.lit(k)) for i, k in enumerate(keys)], F.lit("")) if keys else F.lit("")
    whole = judged.join(files.where("sound"), "file").where("good OR mended").select("file", "good", first.alias("chosen"))
    whole = checkpoint(whole)
    held = found.join(whole, "file").where(~blank)
    value = F.when(F.col("good"), whole_document(text)).otherwise(whole_document(repair_json(text)) if repair else F.lit(None).cast("variant"))
    listed = held.where("top = '[' OR (chosen <> '' AND key = chosen)").select("file", value.alias("record"))
    # an object without such a list is one record
    alone = whole.where("chosen = ''").join(files.where("top = '{'").select("file"), "file").join(found, "file", "left")
    order = F.sort_array(F.collect_list(F.struct("block", "nth", "text")))
    object_ = F.concat(F.lit("{"), F.array_join(F.filter(F.transform(order, lambda x: x["text"]), lambda x: x.rlike(r"[^ \t\r\n\x00-\x1F]")), ","), F.lit("}"))
    single = alone.groupBy("file").agg(object_.alias("text"), F.first("good").alias("good")).select("file", F.when(F.col("good"), whole_document(F.col("text"))).otherwise(whole_document(repair_json(F.col("text")))).alias("record"))
    return listed.unionByName(single), whole.select("file")


def robust_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record VARIANT) of files of JSON, broken JSON, or JSON lines; hopeless lines are skipped.

    gzip files are read by their suffix.  Files that are no one document, even
    repaired, are read by lines.
    """
    good, files = _documents(spark, path, WRAPPER_KEYS, repair=True)
    return good.unionByName(robust_lines(spark, path).join(files, "file", "left_anti").select("file", "record"))


def robust_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, record VARIANT) of JSON lines, each repaired where it must be, read line by line whatever the file's size."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return lines.select("file", parsed(F.col("value")).alias("record")).where("record IS NOT NULL")


def array_or_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed records of a JSON array, an object, or JSON lines without repair; bad lines go."""
    good, files = _documents(spark, path, (), repair=False)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), whole_document(F.col("value")).alias("record")).where("record IS NOT NULL")
    return typed(good.select("record").unionByName(lines.join(files, "file", "left_anti").select("record")), schema)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): NaN and infinities are numbers, blank lines go, bad ones come back as text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    row = F.from_json("value", StructType([*schema.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"})
    rows = lines.select("value", "file", row.alias("x"))
    return rows.where("x._bad IS NULL").select("x.*").drop("_bad"), rows.where("x._bad IS NOT NULL").select(F.col("value").alias("_bad"), "file")


def flattened_questions(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of either an export tree or a flat list; anything else raises."""
    found, files = parts(spark, path, ("videos",))
    shape = files.agg(F.max(F.col("sound") & (F.col("top") == "[")), F.min(F.col("sound"))).first()
    if not shape[1] or (not shape[0] and not found.where("key = 'videos'").limit(1).count()):
        raise ValueError("neither a tree with videos nor a list")
    if not shape[0]:
        return annotation_file(spark, path)
    fields = StructType([*LANGUAGE_QUERY.fields]).add("video_uid", "string")
    return found.where("top = '['").where(F.trim("text") != "").select(F.from_json("text", fields).alias("x")).select("x.*")


def uids(records: DataFrame, record: str = "record") -> DataFrame:
    """Distinct uids of VARIANT records, under any of their usual keys; trees give their videos' uids."""
    inner = F.coalesce(F.try_variant_get(record, "$.videos", "array<variant>"), F.array(record))
    each = records.select(F.explode(inner).alias("r"))
    return each.select(F.coalesce(*[F.try_variant_get("r", f"$.{k}", "string") for k in UID_KEYS]).alias("video_uid")).where("video_uid IS NOT NULL").distinct()


def typed(records: DataFrame, schema: DataType | str, record: str = "record") -> DataFrame:
    return records.select(F.from_json(F.to_json(record), schema).alias("x")).select("x.*")
