"""Schemas of the external shapes."""

from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


NARRATION = _struct(timestamp_sec=DoubleType(), narration_text=StringType(), narration_uid=StringType())
#: An object keyed by video uid.
NARRATION_FILE = MapType(StringType(), _struct(narration_pass_1=_struct(narrations=ArrayType(NARRATION))))
LANGUAGE_QUERY = _struct(template=StringType(), query=StringType(), clip_start_sec=DoubleType(), clip_end_sec=DoubleType(), video_start_sec=DoubleType(), video_end_sec=DoubleType())
ANNOTATION_FILE = _struct(videos=ArrayType(_struct(
    video_uid=StringType(),
    clips=ArrayType(_struct(clip_start_sec=DoubleType(), clip_end_sec=DoubleType(), video_start_sec=DoubleType(), annotations=ArrayType(_struct(language_queries=ArrayType(LANGUAGE_QUERY))))),
)))
FLAT_RECORD = _struct(
    video_uid=StringType(), clip_start_sec=DoubleType(), clip_end_sec=DoubleType(), query_start_sec=DoubleType(), query_end_sec=DoubleType(),
    matched_template=StringType(), narrations=ArrayType(NARRATION), context_text=StringType(),
)
QUESTION = _struct(
    video_uid=StringType(), template=StringType(), query=StringType(), clip_start_sec=DoubleType(), clip_end_sec=DoubleType(),
    query_start_sec=DoubleType(), query_end_sec=DoubleType(), source_narrations=ArrayType(StringType()),
)
TEMPLATE_LINK = _struct(candidate_id=LongType(), template_name=StringType())
PROTOTYPE = _struct(template=StringType(), embedding=ArrayType(DoubleType()))
