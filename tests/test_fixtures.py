"""Edge cases of single operators on small literal inputs."""

import math

from pyspark.sql import functions as F

from conftest import DATA
from strandweave.functions import intervals as iv
from strandweave.functions import templates, texts
from strandweave.operators import cleaning, joins, merge, planning, sampling, stats, windows


def narrations(spark, times, unsure=()):
    rows = [("v", float(t), k, "#unsure x" if k in unsure else f"text {k}") for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "video_uid string, timestamp_sec double, narration_uid long, narration_text string")


def test_buckets(spark):
    values = [-1.0, 0.0, 1.999, 2.0, 59.9, 60.0, 400.0, math.nan]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, d double").select("k", iv.bucket_of(F.col("d")).alias("b")).orderBy("k").collect()
    assert [tuple(r.b) for r in got] == [(32, 60), (0, 2), (0, 2), (2, 4), (32, 60), (32, 60), (32, 60), (32, 60)]


def test_islands_drop_singles(spark):
    got = windows.islands(narrations(spark, [0, 8, 16.001, 40]), 8.0).collect()
    assert sorted(r.timestamp_sec for r in got) == [0, 8]


def test_short_windows(spark):
    got = windows.short_windows(narrations(spark, [0, 1, 4, 5])).collect()
    assert sorted((r.cs, r.ce) for r in got) == [(0, 1), (0, 4), (1, 4), (1, 5), (4, 5)]


def test_unsure_rows_exclude_their_windows(spark):
    got = windows.short_windows(narrations(spark, [0, 1, 4, 5], unsure={1})).collect()
    assert sorted((r.cs, r.ce) for r in got) == [(4, 5)]
    assert windows.short_windows(narrations(spark, [0, 1, 4, 5], unsure={1}), sure_only=False).count() == 5


def test_long_window_is_cut_to_its_bucket(spark):
    got = [r for r in windows.long_windows_v2(narrations(spark, range(8))).collect() if r.cs == 0 and r.width == 3]
    assert (got[-1].ce, got[-1].dur, got[-1].bucket_lo, got[-1].bucket_hi) == (2, 2, 2, 4)
    every = windows.long_windows_v2(narrations(spark, range(8)))
    assert windows.long_windows_v2(narrations(spark, range(8)), dedup=True).count() == every.select("cs", "ce").distinct().count() < every.count()


def test_density(spark):
    rows = [(1, "v", 0.0, 12.0), (2, "v", 0.0, 3.0), (3, "v", 9.0, 12.0), (4, "v", 11.0, 13.0), (5, "w", 1.0, 2.0)]
    got = joins.containment_counts(spark.createDataFrame(rows, "id long, video_uid string, cs double, ce double")).collect()
    assert {r.id: r.density for r in got} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0}


def test_segments_merge_into_the_last(spark):
    row = spark.range(1).select(merge.merged_segments(F.expr("array(struct(3.0D s, 4.0D e), struct(1.0D s, 2.0D e), struct(1.02D s, 2.02D e))")).alias("m")).first()
    assert [(round(x.s, 6), round(x.e, 6)) for x in row.m] == [(1.01, 2.01), (3, 4)]


def test_overlap(spark):
    row = spark.range(1).select(iv.overlaps(*map(F.lit, (0.0, 1.0, 1.0, 2.0))).alias("a"), iv.overlaps(*map(F.lit, (0.0, 1.0, 0.5, 2.0))).alias("b")).first()
    assert (row.a, row.b) == (False, True)


def test_clamp(spark):
    clamp = lambda a, b: iv.clamped_query([(F.lit(a), F.lit(b))], F.lit(10.0), F.lit(20.0))
    row = spark.range(1).select(clamp(25.0, 15.0).alias("a"), clamp(12.0, 12.0).alias("b"), iv.clamped_query([(F.lit(None).cast("double"), F.lit(1.0))], F.lit(10.0), F.lit(20.0)).alias("c")).first()
    assert tuple(row.a) == (15, 20)
    assert [round(x, 6) for x in row.b] == [14.999, 15.001]
    assert tuple(row.c) == (10, 20)


def test_apportionment_breaks_ties_by_key(spark):
    got = planning.apportioned(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long"), ["k"], 10).orderBy("k").collect()
    assert [r.target for r in got] == [4, 3, 3]


def test_thinning(spark):
    row = spark.range(1).select(texts.thinned(F.sequence(F.lit(0), F.lit(9)), 5).alias("x")).first()
    assert row.x == [0, 2, 4, 7, 9]


def test_quota(spark):
    pool = spark.createDataFrame([("a", k) for k in range(3)], "c string, k long")
    plan = spark.createDataFrame([("a", 5), ("b", 2)], "c string, target long")
    got = sampling.quota_sample(pool, plan, ["c"], ["k"]).collect()
    assert len(got) == 5 and {r.k for r in got if r.draw == 0} == {0, 1, 2}
    assert [(r.c, r.deficit) for r in sampling.quota_deficits(pool, plan, ["c"]).collect()] == [("b", 2)]


def test_record_reasons(spark):
    columns = "video_uid string, clip_start_sec double, clip_end_sec double, query_start_sec double, query_end_sec double, matched_template string, context_text string, flag boolean"
    rows = [("v", 0.0, 10.0, 1.0, 1.1, "t", "x", True), ("v", 0.0, 10.0, 9.0, 12.0, "t", "x", True), ("v", 0.0, 10.0, 1.0, 2.0, "t", " ", False), ("v", 5.0, 1.0, 1.0, 2.0, "t", "x", None), (" v ", 0.0, 10.0, 1.0, 2.0, "t", "x", True)]
    got = cleaning.cleaned(spark.createDataFrame(rows, columns)).collect()
    assert [r.reason for r in got] == ["query_too_short", "query_out_of_clip_bounds", "missing_fields:context_text", "clip_bounds_invalid", "ok"]
    assert {r.flag for r in got} == {None} and got[-1].video_uid == "v"


def test_json_repair(spark):
    cases = {"[1,2,]": "[1,2]", '{"a":NaN}': '{"a":null}', '{"a":-Infinity}': '{"a":null}', '{"a":"NaN"}': '{"a":"NaN"}', "a\r\nb\rc\x07": "a\nb\nc"}
    got = spark.createDataFrame([(x,) for x in cases], "s string").select("s", texts.repair_json(F.col("s")).alias("r")).collect()
    assert {r.s: r.r for r in got} == cases


def test_questions(spark):
    row = spark.range(1).select(
        texts.normalized_question(F.lit("Question: what is it.")).alias("a"), texts.normalized_question(F.lit(None).cast("string")).alias("b"),
        templates.template_reason(F.lit("Objects: What did I put in X?"), F.lit("What did C take?")).alias("c"), templates.template_reason(F.lit("Objects: In what location did I see object X ?"), F.lit("Where is the cup?")).alias("d"),
        templates.template_reason(F.lit("Objects: In what location did I see object X ?"), F.lit("Where is the cup?"), strict=False).alias("e"),
    ).first()
    assert tuple(row) == ("what is it?", "", "missing_put_verb", "must_start_what", "ok")


def test_ks_of_equal_and_disjoint_samples(spark):
    rows = spark.createDataFrame([(float(k % 5), k % 2 == 0) for k in range(20)] , "x double, a boolean")
    assert stats.ks_statistic(rows, "x", "a").first().ks < 0.21
    far = spark.createDataFrame([(float(k), k < 5) for k in range(10)], "x double, a boolean")
    assert stats.ks_statistic(far, "x", "a").first().ks == 1.0


def test_chi_square_counts_cells_without_expectation(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "k string, n long")
    b = spark.createDataFrame([("x", 4)], "k string, n long")
    row = stats.chi_square(a, b, ["k"]).first()
    assert (row.n_empty, row.dof) == (1, 1)


def test_shards_have_a_fixed_number_of_rows(spark):
    from strandweave.config import CleanConfig

    got = cleaning.sharded(spark.range(25).withColumnRenamed("id", "k"), ["k"], CleanConfig(shard_rows=10)).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in got] == [10, 10, 5]


def test_first_of_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, v string")
    assert joins.null_safe_anti(rows, spark.createDataFrame([(None,)], "v string"), ["v"]).collect() == [(3, "a")]


def test_prompts_are_built_from_whole_texts(spark):
    from strandweave.plans import registry

    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").collect()}
    long = {k for k, t in texts.items() if len(t) > 250 and "#" not in t}
    got = {(r.conv_id, r.turn): r.prompt for r in registry.queries()["prompt_build"](spark, f"{DATA}/sf0.001").collect()}
    assert long and all(texts[k].split(". ")[-1].strip() in got[k] for k in long)
