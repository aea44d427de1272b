"""Tables that change together, the append index, matrices and converted folders."""

import json

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from strandweave.sources import files, matrices, sinks
from strandweave.sources.batches import Batches, append_catalog
from strandweave.streaming import appends, streams


def candidates(spark, first, n, names="array('a', 'b')"):
    return spark.range(first, first + n).select(F.col("id").alias("event"), F.expr(names).alias("templates"))


def test_a_failing_batch_changes_neither_table(spark, tmp_path):
    batches = Batches(spark, str(tmp_path / "t"))
    assert append_catalog(batches, candidates(spark, 0, 5), ["event"])
    rows = candidates(spark, 5, 4)
    with pytest.raises(SparkRuntimeException):
        append_catalog(batches, rows.withColumn("templates", F.expr("array('a', if(event = 7, raise_error('no'), 'b'))")), ["event"])
    links = rows.select(F.col("event").alias("candidate_id"), F.expr("if(event = 7, raise_error('no'), 'b')").alias("template_name"))
    with pytest.raises(SparkRuntimeException):  # the first table's rows are written by then
        batches.commit({"candidates": rows.select(F.col("event").alias("id"), "event"), "templates": links})
    assert batches.state().version == 1 and batches.read("candidates").count() == 5 and batches.read("templates").count() == 10
    assert append_catalog(batches, candidates(spark, 9, 2), ["event"])
    assert sorted((r["id"], r["event"]) for r in batches.read("candidates").collect()) == [(k + 1, k) for k in range(5)] + [(6, 9), (7, 10)]
    gone = batches.vacuum()
    assert len([g for g in gone if "candidates" in g]) == 1 and batches.read("templates").count() == 14 and batches.state().version == 2


def test_a_replayed_batch_is_not_added(spark, tmp_path):
    batches = Batches(spark, str(tmp_path / "t"))
    assert append_catalog(batches, candidates(spark, 0, 3), ["event"], writer="w", batch=0)
    assert not append_catalog(batches, candidates(spark, 0, 3), ["event"], writer="w", batch=0)
    assert append_catalog(batches, candidates(spark, 3, 1), ["event"], writer="w", batch=1) and batches.read("candidates").count() == 4
    assert append_catalog(batches, candidates(spark, 0, 0), ["event"], writer="w", batch=2) and batches.read("candidates").count() == 4
    with pytest.raises(ValueError):
        batches.read("none")
    assert batches.read("none", "x int").count() == 0


def test_appends_read_their_buckets_alone(spark, tmp_path):
    """Many batches; what the last reads of the index is bounded by its keys, not by the table."""
    sink = appends.Appends(spark, str(tmp_path / "s"), ["k"], fan=4, bucket_keys=16)
    for b in range(22):
        rows = spark.range(b * 40, b * 40 + 48).select(F.col("id").alias("k"), F.lit(b).alias("v")).coalesce(2)  # eight are there already but for the first batch
        assert sink.add(rows, "w", b)
    assert not sink.add(spark.range(5).select(F.col("id").alias("k"), F.lit(0).alias("v")), "w", 21)
    assert sink.table().count() == sink.table().select("k").distinct().count() == 21 * 40 + 48
    runs = sink.batches.state().folders["index"]
    assert len(runs) <= 3 * 4 and sum(r["rows"] for r in runs) == 21 * 40 + 48
    few = spark.range(3).select(F.col("id").alias("k")).withColumn("digest", appends.digest(["k"]))
    assert few.join(sink.known(few), "digest").count() == 3
    # two buckets of about 16 to 32 keys a run and key at most
    assert sink.known(few).count() <= len(runs) * 3 * 40 < 21 * 40


def test_appends_tell_nulls_from_texts(spark, tmp_path):
    sink = appends.Appends(spark, str(tmp_path / "s"), ["a", "b"])
    rows = [("1:x", None), (None, "1:x"), ("-", None), (None, None), (None, None), ("x", "y"), ("x1:", "y")]
    sink.add(spark.createDataFrame(rows, "a string, b string"), "w", 0)
    sink.add(spark.createDataFrame(rows, "a string, b string"), "v", 0)
    assert sink.table().count() == 6


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(240)
    query.stop()


def test_streams_append_without_their_checkpoint(spark, tmp_path):
    spark.createDataFrame([(k % 30, "x") for k in range(60)], "k int, v string").repartition(4).write.parquet(str(tmp_path / "in"))
    for mark in ("m1", "m2"):
        run(appends.append_new(streams.file_stream(spark, str(tmp_path / "in"), "k int, v string"), str(tmp_path / "out"), str(tmp_path / mark), ["k"]))
    assert sorted(r["k"] for r in appends.Appends(spark, str(tmp_path / "out"), ["k"]).table().collect()) == list(range(30))


def ledger_run(spark, tmp_path, marks, ledger, name):
    marks.write.mode("append").parquet(str(tmp_path / "in"))
    found = streams.usage_ledger(streams.file_stream(spark, str(tmp_path / "in"), marks.schema, 100), "k", ledger)
    out = tmp_path / f"out-{name}"
    run(found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"marks-{name}")))
    return {r["k"]: (r["uses"], r["fresh"]) for r in spark.read.schema(found.schema).parquet(str(out)).collect()}


def test_a_ledger_starts_from_what_was_used(spark, tmp_path):
    marks = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int").coalesce(1)
    first = ledger_run(spark, tmp_path, marks, None, "a")
    assert first == {1: (2, True), 2: (1, True), 3: (1, True)}
    # another query over the same marks, which begins with the first one's counts
    ledger = spark.createDataFrame([(k, u) for k, (u, _) in first.items()], "k int, uses bigint")
    marks.limit(0).write.mode("overwrite").parquet(str(tmp_path / "in"))
    again = ledger_run(spark, tmp_path, spark.createDataFrame([(1,), (4,)], "k int").coalesce(1), ledger, "b")
    assert again == {1: (3, False), 4: (1, True)}


def test_a_ledger_forgets_idle_keys(spark, tmp_path):
    from datetime import timedelta

    folder = str(tmp_path / "in")
    rows = [(1, 100), (2, 150), (3, 100_000), (1, 100_010), (3, 300_000)]
    for k, s in rows:
        spark.createDataFrame([(k, s)], "k int, s int").select("k", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(folder)
    found = streams.usage_ledger(streams.file_stream(spark, folder, "k int, at timestamp"), "k", ts="at", idle=timedelta(seconds=1000), late="10 seconds")
    run(found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")))
    got = sorted((r["k"], r["uses"], r["fresh"], r["expired"]) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[0] == 1] == [(1, 1, False, True)] * 2 + [(1, 1, True, False)] * 2
    assert [g for g in got if g[0] == 2] == [(2, 1, False, True), (2, 1, True, False)]


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_matrices_round_trip(spark, tmp_path, single, kind):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.expr(f"transform(sequence(1, 7), x -> cast(id * x / 3 as {kind}))").alias("vector")).repartition(5)
    path = str(tmp_path / "m" / "v.npy")
    matrices.write_matrix(rows, path, "k", single=single)
    if single:
        assert np.load(path).shape == (1000, 7) and np.load(path).dtype == {"float": np.float32, "double": np.float64}[kind]
    got = matrices.read_keyed(spark, path, 7).orderBy("key").collect()
    want = rows.orderBy("k").collect()
    assert [(r["key"], r["vector"]) for r in got] == [(r["k"], r["vector"]) for r in want]


def test_matrices_of_other_programs_and_shapes(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(600, dtype=">i4").reshape(100, 6))
    matrices.register(spark)
    found = spark.read.format("npy").option("block", 100).load(str(tmp_path / "a.npy"))
    assert found.rdd.getNumPartitions() == 25
    assert [r["vector"][0] for r in found.orderBy("row").collect()] == [6.0 * k for k in range(100)]
    with pytest.raises(Exception, match="6 columns instead of 7"):
        matrices.read_matrix(spark, str(tmp_path / "a.npy"), 7).collect()
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.zeros((3, 4))))
    for name in ("cube", "columns"):
        with pytest.raises(Exception, match="not a matrix"):
            matrices.read_matrix(spark, str(tmp_path / f"{name}.npy")).collect()
    with pytest.raises(Exception, match="one length"):
        matrices.write_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k int, vector array<double>"), str(tmp_path / "x.npy"), "k")
    matrices.write_matrix(spark.createDataFrame([], "k int, vector array<double>"), str(tmp_path / "none.npy"), "k")
    assert np.load(tmp_path / "none.npy").shape == (0, 0)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]


def test_a_folder_is_converted_by_a_fixed_number_of_jobs(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        for k in range(1, n + 1):
            (folder / f"f {k}.jsonl").write_text("".join('{"k": %d}\n' % i if i % 3 else "\n" if i % 2 else "bad\n" for i in range(k)))
        group = f"convert{n}"
        spark.sparkContext.setJobGroup(group, group)
        written, bad = files.convert_folder(spark, str(folder), out_folder=str(tmp_path / f"out{n}"))
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k in range(1, n + 1):
            assert json.loads((tmp_path / f"out{n}" / f"f {k}_converted.json").read_text()) == [{"k": i} for i in range(k) if i % 3]
        assert sorted((r["line_no"], r["line"]) for r in bad.collect()) == sorted((i + 1, "bad") for k in range(1, n + 1) for i in range(k) if i % 6 == 0)
        return ran

    assert jobs(4) == jobs(40)


def test_named_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2"), ("b", "x"), ("a", "1")], "f string, line string").select(F.concat(F.lit(f"{tmp_path}/"), "f").alias("out"), "line")
    sinks.write_named_lines(rows, str(tmp_path))
    assert (tmp_path / "a").read_text() == "1\n2\n" and (tmp_path / "b").read_text() == "x\n"
