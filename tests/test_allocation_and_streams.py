"""Invariants of the allocator, and streams against their batch forms."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from strandweave.config import PlanConfig
from strandweave.operators import windows
from strandweave.operators.allocate import allocate
from strandweave.plans import interval_queries
from strandweave.plans.interval_queries import allocation
from strandweave.sources.tables import hours, narrations
from strandweave.streaming import streams

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def placed(spark):
    return allocation(spark, FOLDER).toPandas()


def test_queries_lie_in_their_clips(placed):
    assert len(placed) > 50
    assert (placed.qs >= placed.clip_cs - 1e-3).all() and (placed.qe <= placed.clip_ce + 1e-3).all() and (placed.clip_cs >= 0).all()


def test_no_overlap_and_at_most_ten_per_clip(placed):
    for _, clip in placed.groupby("clip_id"):
        assert len(clip) <= 10 and clip.video_uid.nunique() == 1
        for a, b in combinations(clip.itertuples(), 2):
            assert a.qe <= b.qs + 1e-3 or a.qs >= b.qe - 1e-3


def test_no_event_is_used_twice(placed):
    assert placed.event_id.is_unique


def test_events_are_long_enough_and_clips_end_in_time(placed, spark):
    n = narrations(spark, FOLDER).toPandas()
    length = n.set_index("narration_uid").d
    assert (length[placed.event_id].to_numpy() + 1e-6 >= (placed.qe - placed.qs).to_numpy()).all()
    last = n.groupby("video_uid").timestamp_sec.max() + 600
    assert (placed.clip_ce.to_numpy() <= last[placed.video_uid].to_numpy() + 1e-3).all()


def test_anchors_keep_to_the_plan(placed):
    anchors = placed[placed.role == "a"]
    assert len(anchors) <= 200 and anchors.clip_id.is_unique


def _allocate(spark, refs, events, target):
    cell = {"template": "t", "bucket_lo": 0.0}
    rows = lambda table: spark.createDataFrame([{**cell, **r} for r in table])
    return allocate(
        rows({"ref_id": k, "d": d, "qs_rel": s, "d_rel": 0.5, "clen": 2 * d} for k, (d, s) in enumerate(refs)),
        rows({"event_id": k, "video_uid": 1, "cs": float(cs), "ce": float(ce)} for k, (cs, ce) in enumerate(events)),
        spark.createDataFrame([(1, 1000.0)], "video_uid long, max_ts double"), rows([{"target": target}]),
    ).collect()


def test_short_events_are_not_used_up_by_long_references(spark):
    got = _allocate(spark, [(5.0, 0.0)], [(10 * k, 10 * k + 1) for k in range(60)] + [(700, 706)], 1)
    assert [(r.event_id, r.role) for r in got] == [(60, "a")]


def test_an_event_tries_other_references_while_its_clip_does_not_fit(spark):
    got = _allocate(spark, [(4.0, 0.4)] * 4 + [(4.0, 0.0)], [(0, 6)], 1)
    assert [(r.event_id, r.clip_cs) for r in got] == [(0, 0.0)]


def test_overrunning_events_do_not_end_the_rounds(spark):
    got = _allocate(spark, [(5.0, 0.0)], [(998, 1004)] * 12 + [(100, 106)], 1)
    assert [r.event_id for r in got] == [12]


@pytest.mark.parametrize("seed", [1, 3])
def test_a_clip_finds_the_one_sibling_that_fits(spark, seed):
    """199 siblings of a cell without events, and one with an event."""
    rows = lambda table: spark.createDataFrame(table, "template string, bucket_lo double, ref_id bigint, d double, qs_rel double, d_rel double, clen double")
    refs = rows([("a", 0.0, 0, 2.0, 0.0, 0.2, 10.0)] + [("none", 0.0, k, 2.0, 0.4, 0.2, 10.0) for k in range(1, 200)] + [("b", 0.0, 200, 2.0, 0.4, 0.2, 10.0)])
    events = spark.createDataFrame([("a", 0.0, 1, 7, 50.0, 52.0), ("b", 0.0, 2, 7, 90.0, 93.0)], "template string, bucket_lo double, event_id bigint, video_uid bigint, cs double, ce double")
    plan = spark.createDataFrame([("a", 0.0, 1)], "template string, bucket_lo double, target bigint")
    got = allocate(refs, events, spark.createDataFrame([(7, 1000.0)], "video_uid bigint, max_ts double"), plan, seed=seed).collect()
    assert sorted((r.event_id, r.role) for r in got) == [(1, "a"), (2, "f")]


@pytest.mark.parametrize("block", [24])
def test_no_clip_under_ten_has_a_sibling_that_still_fits(spark, monkeypatch, block):
    """Few events for many siblings, some of several templates; all claims are held against plain loops."""
    import random
    from strandweave.operators import allocate as module

    monkeypatch.setattr(module, "FIRST_BLOCK", block)
    rnd = random.Random(block)
    refs = [(rnd.choice("abc"), 0.0, k, round(rnd.uniform(0.5, 3), 2), round(rnd.uniform(0, 0.8), 2), 0.0) for k in range(60)]
    refs = [(t, b, k, d, s, d_rel := round(rnd.uniform(0.05, 0.2), 2), round(d / d_rel, 3)) for t, b, k, d, s, _ in refs]
    events = [(t, 0.0, k, rnd.choice([7, 8, 9]), float(10 * k + 30), 10 * k + 30 + round(rnd.uniform(0.5, 4), 2)) for k in range(45) for t in rnd.sample("abc", rnd.choice([1, 1, 2]))]
    got = allocate(
        spark.createDataFrame(refs, "template string, bucket_lo double, ref_id bigint, d double, qs_rel double, d_rel double, clen double"), spark.createDataFrame(events, "template string, bucket_lo double, event_id bigint, video_uid bigint, cs double, ce double"),
        spark.createDataFrame([(v, 2000.0) for v in (7, 8, 9)], "video_uid bigint, max_ts double"), spark.createDataFrame([(t, 0.0, 4) for t in "abc"], "template string, bucket_lo double, target bigint"), most_rounds=2,
    ).toPandas()
    assert len(got[got.role == "a"]) > 3 and len(got[got.role == "f"]) > 3 and got.event_id.is_unique
    used = set(got.event_id)
    for _, clip in got.groupby("clip_id"):
        for a, b in combinations(clip.itertuples(), 2):
            assert a.qe <= b.qs + 1e-3 or a.qs >= b.qe - 1e-3
        if len(clip) >= 10:
            continue
        lo, hi, video = clip.clip_cs.iloc[0], clip.clip_ce.iloc[0], clip.video_uid.iloc[0]
        for t, _, _, d, s, d_rel, clen in refs:
            if abs(clen - (hi - lo)) > 10 - 1e-6:
                continue
            qs, qe = lo + s * (hi - lo), lo + (s + d_rel) * (hi - lo)
            if qe - qs < 0.4 + 1e-6 or abs(qe - qs - d) > 0.15 * d - 1e-6 or qe > hi - 1e-6 or any(not (qe <= c.qs + 1e-3 or qs >= c.qe - 1e-3) for c in clip.itertuples()):
                continue
            own = clip[(abs(clip.qs - qs) < 1e-9) & (clip.role == "a")]
            assert len(own) or not [e for e in events if e[0] == t and e[3] == video and e[2] not in used and e[5] - e[4] >= qe - qs], "a sibling still fits"


def test_allocation_by_duration_alone(spark):
    """geom_only: templates don't matter, and an event of several is one."""
    refs = spark.createDataFrame([("x", 0.0, 1, 2.0, 0.1, 0.2, 10.0), ("y", 0.0, 2, 2.0, 0.6, 0.2, 10.0)], "template string, bucket_lo double, ref_id bigint, d double, qs_rel double, d_rel double, clen double")
    events = spark.createDataFrame([("p", 0.0, 1, 7, 50.0, 53.0), ("q", 0.0, 1, 7, 50.0, 53.0), ("q", 0.0, 2, 7, 90.0, 93.0)], "template string, bucket_lo double, event_id bigint, video_uid bigint, cs double, ce double")
    plan = spark.createDataFrame([("x", 0.0, 1), ("z", 0.0, 0)], "template string, bucket_lo double, target bigint")
    got = allocate(refs, events, spark.createDataFrame([(7, 1000.0)], "video_uid bigint, max_ts double"), plan, geom_only=True).collect()
    assert sorted(r.event_id for r in got) == [1, 2] and {r.template for r in got} == {""} and sorted(r.role for r in got) == ["a", "f"]


def test_the_registered_allocation_has_the_full_target(spark, monkeypatch):
    monkeypatch.setattr(interval_queries, "allocation", lambda s, d, total=None: total)
    assert interval_queries.allocate(spark, FOLDER) == PlanConfig().final_target


def _stream(spark, tmp_path, rows):
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    return streams.file_stream(spark, str(tmp_path / "in"), rows.schema)


def _run(query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return query.sparkSession.table(name)


def test_sessions_equal_islands(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(streams.sessions(_stream(spark, tmp_path, events), "user_id", "ts"), "found_sessions")
    batch = windows.islands(narrations(spark, f"{DATA}/sf0.001"), 8.0).groupBy("video_uid", "island").agg(F.count("*").alias("n"), F.max("timestamp_sec").alias("last"))
    closed = events.select(hours("cast(ts as timestamp_ntz)").alias("t")).agg(F.max("t")).first()[0] - 9  # the watermark has not passed the last ones
    want = sorted((r.video_uid, r.n) for r in batch.collect() if r["last"] + 8 < closed)
    have = sorted((r.user_id, r.n) for r in got.collect())
    assert len(have) >= len(want) > 0 and set(want) <= set(have)


def test_dedup_within_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 2)], "k int, v string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert _run(streams.first_of_key(_stream(spark, tmp_path, rows), ["v"], "ts"), "found_firsts").count() == 2


def test_rolling_counts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(streams.rolling_counts(_stream(spark, tmp_path, events), "user_id", "ts"), "found_rolling")
    assert got.count() > 0 and got.agg(F.min("n")).first()[0] >= 4
