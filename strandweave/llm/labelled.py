"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, n_folds: int = 4, held_out_fold: int = 2, per_class: bool = False, part: int = 0, parts: int = 1, id_col: str = "doc_id", text_col: str = "text", most_bytes: int | None = None, chars_col: str = "n_chars") -> DataFrame:
    """(text, label, recorded) of at most ``rows`` labelled documents outside the held-out fold (``rows`` of each class with ``per_class``).

    The rows with the smallest hash of their id are taken, so the sample is the
    same in every run; with ``most_bytes`` as many of them as have so many bytes
    of text.  ``part`` of ``parts`` keeps disjoint samples apart.  Labels that
    are null or not 0 or 1 are no labels.  ``recorded`` is ``chars_col``, null
    where docs has no such column.
    """
    hashed = labels.select(F.col(id_col).alias("key"), F.col(target).try_cast("int").alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
    hashed = hashed.where(fold("key", n_folds) != held_out_fold).withColumn("order", F.xxhash64("key", F.lit(17))).where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(parts)) == part)
    if per_class:
        chosen = hashed.where("label = 1").orderBy("order").limit(rows).union(hashed.where("label = 0").orderBy("order").limit(rows))
    else:
        chosen = hashed.orderBy("order").limit(rows)
    recorded = F.col(chars_col) if chars_col in docs.columns else F.lit(None)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), recorded.try_cast("long").alias("recorded"))
    if most_bytes is not None:
        # at most ``rows`` keys: their sizes are added up in order
        sizes = texts.join(F.broadcast(chosen.select("key").distinct()), "key").groupBy("key").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
        ordered = chosen.join(F.broadcast(sizes), "key").withColumn("total", F.sum("size").over(Window.orderBy("order", "key", "label")))
        chosen = ordered.where(F.col("total") <= most_bytes)
    # the chosen rows are bounded by the parameter, so they may be broadcast
    return texts.join(F.broadcast(chosen.select("key", "label")), "key").select("text", "label", "recorded")
