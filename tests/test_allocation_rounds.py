"""How much work fills take: rounds depend on refusals, not on the number of siblings."""

from strandweave.operators import allocate as module


def _work(spark, monkeypatch, siblings):
    """(checkpoints, placed) of one clip that no sibling but the last fits."""
    count = [0]
    checkpoint = module._checkpoint

    def counted(df):
        count[0] += 1
        return checkpoint(df)

    refs = [("a", 0.0, 0, 2.0, 0.0, 0.2, 10.0)] + [("none", 0.0, k, 2.0, 0.4, 0.2, 10.0) for k in range(1, siblings)] + [("b", 0.0, siblings, 2.0, 0.4, 0.2, 10.0)]
    events = spark.createDataFrame([("a", 0.0, 1, 7, 50.0, 52.0), ("b", 0.0, 2, 7, 90.0, 93.0), ("b", 0.0, 3, 7, 95.0, 96.0)], "template string, bucket_lo double, event_id bigint, video_uid bigint, cs double, ce double")
    with monkeypatch.context() as patch:
        patch.setattr(module, "_checkpoint", counted)
        got = module.allocate(
            spark.createDataFrame(refs, "template string, bucket_lo double, ref_id bigint, d double, qs_rel double, d_rel double, clen double"), events, spark.createDataFrame([(7, 1000.0)], "video_uid bigint, max_ts double"),
            spark.createDataFrame([("a", 0.0, 1)], "template string, bucket_lo double, target bigint"),
        ).collect()
    return count[0], sorted((r.event_id, r.role) for r in got)


def test_more_siblings_take_no_more_rounds(spark, monkeypatch):
    few, many = _work(spark, monkeypatch, 20), _work(spark, monkeypatch, 3000)
    assert few[1] == many[1] == [(1, "a"), (2, "f")]
    assert many[0] == few[0]


def test_plans_do_not_grow_with_rounds(spark, monkeypatch):
    """Clips that want one video's events at the same place are refused again and again."""
    leaves, checkpoint = [], module._checkpoint

    def measured(df):
        leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return checkpoint(df)

    monkeypatch.setattr(module, "_checkpoint", measured)
    n = 24
    refs = [("a", 0.0, 0, 20.0, 0.0, 0.2, 100.0)] + [("b", 0.0, k, 5 + k - 0.5, 0.5, (5 + k - 0.5) / 100, 100.0) for k in range(1, n)]
    events = [("a", 0.0, 1000 + k, 7, 200.0 * k, 200.0 * k + 20.0) for k in range(n)] + [("b", 0.0, k, 7, 20.0, 25.0 + k) for k in range(1, n)]
    got = module.allocate(
        spark.createDataFrame(refs, "template string, bucket_lo double, ref_id bigint, d double, qs_rel double, d_rel double, clen double"),
        spark.createDataFrame(events, "template string, bucket_lo double, event_id bigint, video_uid bigint, cs double, ce double"),
        spark.createDataFrame([(7, 10000.0)], "video_uid bigint, max_ts double"), spark.createDataFrame([("a", 0.0, n)], "template string, bucket_lo double, target bigint"), most_rounds=1,
    ).toPandas()
    assert (got.role == "a").sum() == n and (got.role == "f").sum() > n // 2
    assert max(leaves) <= 10
