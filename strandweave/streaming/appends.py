"""A resumable sink without a scan of the table: an index of key digests beside it.

Table and index are changed together (see Batches), so a replay of a batch is a
no-op, and rows and their keys are there or not, never one of them.  The index
is a few sorted runs: each micro-batch adds one, and ``FAN`` runs of one level
are merged to one of the next, so a key is rewritten once for each level and
there are FAN - 1 runs at most on each.  A run is divided by leading bits of
the digests into buckets of about ``BUCKET_KEYS`` keys, and a micro-batch reads
the buckets of its own keys alone: for each run, as many buckets as it has keys
at most, whatever the table has grown to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.materialise import checkpoint
from ..sources.batches import Batches, State

FAN, BUCKET_KEYS, MOST_BITS = 8, 1 << 15, 12


def digest(keys: list[str]) -> Column:
    """16 bytes that stand for a key, nulls apart from texts."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _bucket(bits: int) -> Column:
    """The leading bits of a digest as a number."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - bits)


class Appends:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], fan: int = FAN, bucket_keys: int = BUCKET_KEYS):
        self.batches, self.keys, self.fan, self.bucket_keys = Batches(spark, path), keys, fan, bucket_keys

    def _bits(self, n: int) -> int:
        return min(MOST_BITS, max(0, (n // self.bucket_keys).bit_length()))

    def known(self, digests: DataFrame, state: State | None = None) -> DataFrame | None:
        """(digest) that the index has in the buckets of ``digests``; None if there is no index."""
        runs = (state or self.batches.state()).folders.get("index", [])
        found = None
        for bits in sorted({x["bits"] for x in runs}):
            # at most 2^MOST_BITS numbers
            touched = [r["bucket"] for r in digests.select(_bucket(bits).alias("bucket")).distinct().collect()]
            own = self.batches.read("index", where=F.col("bucket").isin(touched), folders=[x for x in runs if x["bits"] == bits]).select("digest")
            found = own if found is None else found.unionByName(own)
        return found

    def _run(self, digests: DataFrame, level: int) -> tuple[DataFrame, dict]:
        n = digests.count()
        bits = self._bits(n)
        rows = digests.select("digest", _bucket(bits).alias("bucket"))
        return rows.repartition(max(1, min(1 << bits, n // self.bucket_keys)), "bucket").sortWithinPartitions("bucket", "digest"), {"level": level, "bits": bits, "rows": n}

    def add(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Append the rows whose key the table has not; False if this batch was added before."""
        state = self.batches.state()
        if state.done.get(writer, -1) >= batch:
            return False
        fresh = checkpoint(rows.dropDuplicates(self.keys).withColumn("digest", digest(self.keys)))
        known = self.known(fresh, state)
        if known is not None:
            fresh = checkpoint(fresh.join(known, "digest", "left_anti"))
        run, about = self._run(fresh.select("digest"), 0)
        gone: list[dict] = []
        # as many runs of a level are one of the next
        while True:
            same = [x for x in state.folders.get("index", []) if x["level"] == about["level"] and x not in gone]
            if len(same) < self.fan - 1:
                break
            gone += same
            merged = self.batches.read("index", folders=same).select("digest").unionByName(run.select("digest"))
            run, about = self._run(merged, about["level"] + 1)
        return self.batches.commit({"data": fresh.drop("digest"), "index": run}, writer, batch, {"index": [x["path"] for x in gone]}, partition={"index": "bucket"}, about={"index": about})

    def table(self) -> DataFrame:
        return self.batches.read("data")


def append_new(rows: DataFrame, path: str, checkpoint_path: str, keys: list[str], **options: int) -> DataStreamWriter:
    """Write a stream to such a sink; a new query over the same rows adds nothing twice, even without the old one's checkpoint."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint_path
        Appends(spark, path, keys, **options).add(batch, query, number)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_path)
