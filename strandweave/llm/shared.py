"""Materialisation and graph helpers of the iterative operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a join side that may be broadcast after they were counted, at 16 bytes or so each.
BROADCAST_ROWS = 2_000_000
RELEASE_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; on one machine alone a local one where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    folder = context.getCheckpointDir()
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a larger frame: a compressed table in the shared folder, of which later reads take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node.

    Alternates large-star and small-star steps until the edge set is stable;
    every step aggregates before it joins, and lineage is cut each round.
    """
    state = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    mark = state.agg(*size).first()
    for _ in range(max_rounds):
        # at most two nodes an edge; beyond the bound the sides are dealt out, and a hub's edges are split as skewed
        side = F.broadcast if 2 * mark[0] <= BROADCAST_ROWS else (lambda df: df)
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(side(least), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(side(lowest), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        state = checkpoint(star)
        now = state.agg(*size).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    pairs = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def release(spark: SparkSession, exchanged: int) -> None:
    """Let the driver notice frames that are gone, so that the files of their exchanges are deleted; a variable that holds one keeps them.

    It takes seconds, so frames that have ``exchanged`` few bytes, about, are left to the JVM.
    """
    if exchanged < RELEASE_BYTES:
        return
    gc.collect()
    time.sleep(2)  # a thread of the Python client tells the JVM of objects that are gone, once a second
    for _ in range(2):  # what is reachable from an object with a finaliser goes by the next collection
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc, text): the rows as structs, each with a key of its own that sorts by id and is never null.

    The id alone where none is null or repeated; else rows with a null or
    repeated id have their text's hash and a number besides, held by a checkpoint.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    repeated = checkpoint(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").select("id"))
    if not repeated.limit(1).count():
        return rows.select("row", F.col("id").alias("doc"), "text")
    none = F.lit(None).cast("long")
    plain = F.struct("id", none.alias("h"), none.alias("k")).alias("doc")
    marked = rows.alias("a").join(small(repeated.select("id", F.lit(True).alias("odd"))).alias("b"), F.expr("a.id <=> b.id"), "left").select("row", "a.id", "text", F.expr("odd IS NOT NULL").alias("odd"))
    odd = checkpoint(marked.where("odd").select("row", F.struct("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k")).alias("doc"), "text"))
    return marked.where("NOT odd").select("row", plain, "text").unionByName(odd)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
