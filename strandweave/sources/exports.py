"""The nested document of questions, written by any number of tasks.

merge.nested() gathers an entity's questions in one row, which an entity with
a third of all questions does not fit into.  Here each question is a line that
knows by itself which brackets it opens and closes, from the least and greatest
numbers in its clip and in its video.  Lines are sorted over ranges of (video,
clip, question), so an entity may lie in many parts, and the parts in order of
their names are one JSON document.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialise import checkpoint
from ..operators.merge import derived_ids
from .staged import located, new_name

#: Bytes of a piece that join_parts() copies.
PIECE = 8 << 20


def _opened(*fields: Column | str) -> Column:
    """A JSON object of the fields without its last bracket."""
    text = F.to_json(F.struct(*fields))
    return F.substring(text, F.lit(1), F.length(text) - 1)


def tree_lines(rows: DataFrame, arrival: str) -> DataFrame:
    """(at, video_uid, clip_idx, query_idx, line): in order of the first four, the document of merge.nested(), videos by uid.

    Questions without a text, a video or ends are left out; without any
    question the document has no videos.
    """
    ids = checkpoint(derived_ids(rows, arrival).where(F.length(F.trim(F.coalesce("query", F.lit("")))) > 0))
    clips = ids.groupBy("video_uid", "clip_idx").agg(F.min("query_idx").alias("first_query_"), F.max("query_idx").alias("last_query_"))
    videos = clips.groupBy("video_uid").agg(F.min("clip_idx").alias("first_clip_"), F.max("clip_idx").alias("last_clip_"))
    one = videos.agg(F.min("video_uid").alias("first_video_"))
    met = ids.join(clips.join(videos, "video_uid"), ["video_uid", "clip_idx"]).join(F.broadcast(one))  # one row
    opens_clip, closes_clip = F.col("query_idx") == F.col("first_query_"), F.col("query_idx") == F.col("last_query_")
    opens_video, closes_video = opens_clip & (F.col("clip_idx") == F.col("first_clip_")), closes_clip & (F.col("clip_idx") == F.col("last_clip_"))
    clip = _opened("clip_idx", "clip_uid", "clip_start_sec", "clip_end_sec", F.col("clip_start_sec").alias("video_start_sec"), F.col("clip_end_sec").alias("video_end_sec"))
    question = F.to_json(F.struct("query_idx", F.trim("query").alias("query"), "template", "clip_start_sec", "clip_end_sec", "video_start_sec", "video_end_sec", "query_id"))
    line = F.concat(
        F.when(opens_video & (F.col("video_uid") == F.col("first_video_")), F.lit("")).otherwise(F.lit(",")),
        F.when(opens_video, F.concat(_opened("video_uid"), F.lit(',"clips":['))).otherwise(F.lit("")),
        F.when(opens_clip, F.concat(clip, F.lit(',"annotations":['), _opened("annotation_uid"), F.lit(',"language_queries":['))).otherwise(F.lit("")),
        question,
        F.when(closes_clip, F.lit("]}]}")).otherwise(F.lit("")), F.when(closes_video, F.lit("]}")).otherwise(F.lit("")),
    )
    body = met.select(F.lit(1).alias("at"), "video_uid", "clip_idx", "query_idx", line.alias("line"))
    kinds = {f.name: f.dataType for f in body.schema}
    around = rows.sparkSession.createDataFrame([(0, '{"videos":['), (2, "]}")], "at int, line string")
    return body.unionByName(around.select("at", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("video_uid", "clip_idx", "query_idx")], "line"))


def write_tree(rows: DataFrame, path: str, arrival: str, parts: int | None = None) -> None:
    """The document as text files, which are it in order of their names."""
    order = ["at", "video_uid", "clip_idx", "query_idx"]
    lines = tree_lines(rows, arrival)
    placed = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    placed.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, folder: str, out: str, head: str = "", tail: str = "", separator: str = "") -> None:
    """One file of a folder's parts, for readers that need one: a task streams them piece by piece, and the file takes its name when it is whole.

    head and tail go around the parts, without the ``separator`` that ends the last of them.
    """
    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, own = located(folder)
            parts = [f for f in system.get_file_info(fs.FileSelector(own)) if f.base_name.startswith("part-")]
            left = sum(f.size for f in parts) - len(separator.encode())
            into, there = located(new_name(posixpath.dirname(out)))
            into.create_dir(posixpath.dirname(there))
            try:
                with into.open_output_stream(there) as sink:
                    sink.write(head.encode())
                    for part in sorted(parts, key=lambda f: int(re.search(r"part-(\d+)", f.base_name)[1])):
                        with system.open_input_stream(part.path) as source:
                            while left > 0 and (piece := source.read(min(PIECE, left))):
                                sink.write(piece)
                                left -= len(piece)
                    sink.write(tail.encode())
            except Exception:
                into.delete_file(there)
                raise
            yield pa.record_batch({"written": [there]})

    written = spark.range(0, 1, 1, 1).mapInArrow(copied, "written string").first()["written"]
    system, own = located(out)
    system.move(written, own)
