"""Nested documents in parts, records of unknown shape, and frames of two samples."""

import json
import math

import pytest
from pyspark.sql import functions as F

from strandweave.operators import cleaning, merge, sampling, stats
from strandweave.sources import exports, json_scan, sinks

ROWS = "arrival bigint, video_uid string, clip_start_sec double, clip_end_sec double, video_start_sec double, video_end_sec double, template string, query string"


def _written(spark, rows, folder, parts):
    exports.write_tree(rows, str(folder / "tree"), "arrival", parts)
    exports.join_parts(spark, str(folder / "tree"), str(folder / "out" / "tree.json"))
    return json.loads((folder / "out" / "tree.json").read_text())


@pytest.mark.parametrize("parts", [1, 5])
def test_a_document_in_parts_equals_the_nested_rows(spark, tmp_path, parts):
    """A hot video over several parts, blank first and last questions, swapped and missing ends, quotes in names."""
    rows = [(k, "hot", float(k % 3), k % 3 + 8.0, 1.0, 2.0, None if k % 4 else "t", " " if k in (0, 1, 39, 20) else f' ask "{k}"? ') for k in range(40)]
    rows += [(50, 'a"b', 9.0, 1.0, 1.0, 2.0, "t", "swapped?"), (51, "blank", 0.0, 1.0, 1.0, 2.0, "t", None), (52, "no end", 0.0, None, 1.0, 2.0, "t", "kept?"), (53, "", 0.0, 1.0, 1.0, 2.0, "t", "gone?"), (54, None, 0.0, 1.0, 1.0, 2.0, "t", "gone?"), (54, "z", 0.0, 1.0, None, None, "t", "é\n?")]
    table = spark.createDataFrame(rows, ROWS)
    got = _written(spark, table, tmp_path, parts)
    want = sorted((json.loads(x) for x in merge.nested(table, "arrival").toJSON().collect()), key=lambda v: v["video_uid"])
    assert got == {"videos": want} and len(want) > 2
    assert len(list((tmp_path / "tree").glob("part-*"))) == parts


def test_a_document_without_questions(spark, tmp_path):
    assert _written(spark, spark.createDataFrame([], ROWS), tmp_path, 3) == {"videos": []}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["tree.json"]


def _sanitized(spark, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("record", F.try_parse_json("t"))
    return [r.x for r in cleaning.sanitized_records(rows).orderBy("k").select(F.to_json("record").alias("x")).collect()]


def test_records_of_any_shape(spark):
    got = _sanitized(spark, '{"b": [null, " ", [], {"x": false}], "a": " y\\u00a0", "c": 12345678901234567890, "d": 1.5}', "true", '"  "', "[1, [2, [null]]]", None, "broken", "{}", '{"_": {"é": "ß "}}')
    assert got == ['{"a":"y","b":[[],{}],"c":12345678901234567890,"d":1.5}', None, None, "[1,[2,[]]]", None, None, "{}", '{"_":{"é":"ß"}}']


def test_deep_records(spark):
    assert _sanitized(spark, "[" * 900 + '" x "' + "]" * 900) == ["[" * 900 + '"x"' + "]" * 900]


def test_records_that_are_typed_agree_with_the_schema_form(spark):
    kind = "a string, b array<string>, c struct<d: boolean, e: string>, n double"
    rows = spark.createDataFrame([(" x ", ["", "y ", None], (True, " "), 2.0), (None, None, None, None), ("", [], (None, "z"), -0.5)], kind)
    own = cleaning.sanitized_rows(rows).collect()
    texts = [json.dumps(r.asDict(recursive=True)) for r in rows.collect()]
    for r, got in zip(own, _sanitized(spark, *texts), strict=True):
        want = {k: v for k, v in r.asDict(recursive=True).items() if v is not None}
        if "c" in want:
            want["c"] = {k: v for k, v in want["c"].items() if v is not None}
        assert json.loads(got) == want


def test_profile_of_records(spark):
    rows = spark.createDataFrame([('{"a": null, "b": 1}',), ('{"a": 2}',), ("[1]",), ("null",), (None,), ("{}",)], "t string").withColumn("record", F.try_parse_json("t"))
    assert sorted(tuple(r) for r in cleaning.record_profile(rows).collect()) == [("a", 2, 1), ("b", 1, 0)]


def test_two_distribution_functions(spark):
    rows = spark.createDataFrame([(1.0, True), (1.0, True), (3.0, True), (2.0, False), (3.0, False), (None, True)], "v double, first boolean")
    got = sorted(tuple(r) for r in stats.distribution_pairs(rows, "v", "first").collect())
    assert [tuple(round(x, 6) for x in r) for r in got] == [(1.0, 0.666667, 0.0, 3, 2), (2.0, 0.666667, 0.5, 3, 2), (3.0, 1.0, 1.0, 3, 2)]
    alone = stats.distribution_pairs(rows.where("first"), "v", "first").collect()
    assert all(r.cdf_second is None and r.n_second == 0 for r in alone) and len(alone) == 2
    assert stats.distribution_pairs(rows.where("false"), "v", "first").count() == 0


def test_grids_have_every_bucket_of_every_template(spark):
    cells = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 4.0)], "template string, bucket_lo double")
    got = {(r.template, r.bucket_lo): (r.share_first, r.share_second) for r in stats.heatmaps(cells, cells.where("template = 'b'"), "template").collect()}
    assert len(got) == 12 and got["b", 4.0] == (1 / 3, 1.0) and got["a", 0.0] == (2 / 3, 0.0) and got["a", 32.0] == (0.0, 0.0)
    none = stats.heatmaps(cells, cells.where("false"), "template").collect()
    assert len(none) == 12 and all(r.share_second == 0.0 for r in none)


def test_chi_square_of_rebuilt_counts(spark):
    shares = lambda *x: spark.createDataFrame(list(zip("abc", x)), "k string, share double")
    got = stats.rebuilt_chi_square(shares(0.5, 0.25, 0.25), shares(0.5, 0.5), ["k"], 10, 100).first()
    # rebuilt: 5, 2, 2 (halves to even) against 50, 50 scaled to 9
    assert math.isclose(got.chi2, (5 - 4.5) ** 2 / 4.5 + (2 - 4.5) ** 2 / 4.5) and (got.dof, got.n_empty) == (2, 1)


def test_pools_leave_out_what_has_no_length_or_template(spark):
    rows = spark.createDataFrame([(1, "0", "3", "t"), (2, "1", "1", "t"), (3, "x", "3", "t"), (4, "0", "3", ""), (5, "0", "3", None), (6, "2", "1", "t"), (7, None, "3", "t"), (8, "NaN", "3", "t"), (9, "0", "1e-10", "t")], "k int, s string, e string, template string")
    assert [(r.k, r.d, r.bucket_lo) for r in sampling.candidate_pool(rows, "s", "e").collect()] == [(1, 3.0, 2.0)]


def test_a_document_of_more_than_a_million_rows(spark, tmp_path):
    path = str(tmp_path / "d")
    sinks.write_document(spark.range(1_000_001).repartition(3), path)
    found = json_scan.parts(spark, path, ("videos",))[0].where("key = 'videos'").select(F.from_json("text", "id bigint").alias("x"))
    assert found.agg(F.count("x.id"), F.min("x.id"), F.max("x.id")).first()[:] == (1_000_001, 0, 1_000_000)


def test_a_document_replaces_the_one_before(spark, tmp_path):
    for rows in ([(1, 'a "quoted",\nline', None)], [], [(k, ",", 0.5) for k in range(9)]):
        sinks.write_document(spark.createDataFrame(rows, "k long, p string, x double").repartition(4), str(tmp_path / "d"), key='the "key"')
        (text,) = (r.value for r in spark.read.option("wholetext", True).text(str(tmp_path / "d")).collect())
        got = json.loads(text)['the "key"']
        assert sorted((r["k"], r["p"], r.get("x")) for r in got) == rows
