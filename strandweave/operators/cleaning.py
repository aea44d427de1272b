"""Record cleaning: sanitised values, reasons, counts, shards."""

from __future__ import annotations

import json
import math
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, StringType, StructType

from ..config import CleanConfig
from ..functions.intervals import finite
from ..functions.templates import first_reason
from ..functions.texts import strip
from .windows import numbered

REQUIRED = ("video_uid", "clip_start_sec", "clip_end_sec", "query_start_sec", "query_end_sec", "matched_template", "context_text")


def sanitized(value: Column, kind: DataType) -> Column:
    """Strings stripped, empty ones and numbers that aren't finite null, nulls out of lists, booleans null; inside structs and lists too."""
    if isinstance(kind, StringType):
        return F.nullif(strip(value), F.lit(""))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(finite(value), value)
    if isinstance(kind, BooleanType):
        return F.lit(None).cast("boolean")
    if isinstance(kind, ArrayType):
        return F.filter(F.transform(value, lambda x: sanitized(x, kind.elementType)), lambda x: x.isNotNull())
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[sanitized(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def sanitized_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[sanitized(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])


#: Calls that a worker may nest: JSON is parsed to a depth of 1,000.
DEPTH = 5000


def _sanitized_value(value: object) -> object:
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, list):
        return [x for x in map(_sanitized_value, value) if x is not None]
    if isinstance(value, dict):
        return {k: x for k, v in value.items() if (x := _sanitized_value(v)) is not None}
    return value


@F.pandas_udf(StringType())
def _sanitized_texts(texts: pd.Series) -> pd.Series:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
    cleaned_ = (None if t is None else _sanitized_value(json.loads(t)) for t in texts)
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in cleaned_], dtype=object)


def sanitized_records(records: DataFrame, record: str = "record") -> DataFrame:
    """sanitized() for VARIANT records of any shape and depth, without a schema or an exchange.

    Nulls leave lists and objects, whose emptied forms stay; a record that is
    null, blank or a truth value becomes null.  Whole numbers stay exact, others
    are doubles.  Other columns are kept.
    """
    text = _sanitized_texts(F.to_json(record))
    return records.withColumn(record, F.parse_json(text))


def record_profile(records: DataFrame, record: str = "record") -> DataFrame:
    """(field, n, n_null): how many VARIANT records have a top-level field, and have it null; records that are no objects have no fields."""
    fields = records.select(record).lateralJoin(records.sparkSession.tvf.variant_explode(F.col(record).outer())).where("key IS NOT NULL")
    return fields.groupBy(F.col("key").alias("field")).agg(F.count("*").alias("n"), F.sum(F.is_variant_null("value").cast("long")).alias("n_null"))


def record_reason(rows: DataFrame, config: CleanConfig = CleanConfig()) -> Column:
    """The first failure of a flat record, in a fixed order, else ``ok``.  A null field is a missing one, as sanitising drops nulls."""
    there = set(rows.columns)
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) if c in there else F.lit(c) for c in REQUIRED]), lambda x: x.isNotNull())
    cs, ce, qs, qe = (F.try_to_number(F.lit(None).cast("string"), F.lit("9")).cast("double") if c not in there else F.col(c).try_cast("double") for c in ("clip_start_sec", "clip_end_sec", "query_start_sec", "query_end_sec"))
    reason = first_reason([
        (cs.isNull() | ce.isNull() | qs.isNull() | qe.isNull(), "timestamps_none"),
        (~((cs >= 0) & (cs < ce)), "clip_bounds_invalid"),
        (~((cs - config.eps <= qs) & (qs < qe) & (qe <= ce + config.eps)), "query_out_of_clip_bounds"),
        (qe - qs < config.least_query, "query_too_short"),
        (qe - qs > config.longest_query, "query_too_long"),
        (F.col("matched_template") == "" if "matched_template" in there else F.lit(False), "template_empty"),
        (F.col("video_uid") == "" if "video_uid" in there else F.lit(False), "video_uid_empty"),
    ])
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing_fields:"), F.array_join(missing, ","))).otherwise(reason)


def cleaned(rows: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Sanitised rows with their ``reason``; keep those that are ok, count the others."""
    clean = sanitized_rows(rows)
    return clean.withColumn("reason", record_reason(clean, config))


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(F.regexp_replace(reason, ":.*", "").alias("reason")).agg(F.count("*").alias("n"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_null, n_nan) in one pass."""
    kinds = dict(rows.dtypes)
    counts = []
    for c in columns:
        nan = F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)
        counts += [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__null"), F.sum(F.coalesce(nan, F.lit(False)).cast("long")).alias(f"{c}__nan")]
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__nan").alias("n_nan")) for c in columns])
    return rows.agg(*counts).select(F.explode(entries).alias("e")).select("e.*")


def sharded(rows: DataFrame, order: list[str], config: CleanConfig = CleanConfig()) -> DataFrame:
    """Adds ``shard``: consecutive runs of the order, of a fixed number of rows.

    Numbers come from range partitions and what the ranges before hold, not from one sorted task.
    """
    return numbered(rows, order, "shard").withColumn("shard", F.floor(F.col("shard") / config.shard_rows).cast("long"))
