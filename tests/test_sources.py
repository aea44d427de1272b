"""JSON readers, file listings, converters and sinks on files of their own."""

import gzip
import json

import pytest

from strandweave.schemas import QUESTION
from strandweave.sources import files, json_files, sinks

TREE = {"videos": [{"video_uid": "v", "clips": [{"clip_start_sec": 0, "clip_end_sec": 9, "video_start_sec": 5, "annotations": [{"language_queries": [{"template": "t", "clip_start_sec": 1, "clip_end_sec": 2}, {"template": None}]}]}, {"clip_start_sec": 1, "annotations": []}]}]}


def put(path, text):
    path.write_text(text)
    return str(path)


def test_narration_file(spark, tmp_path):
    path = put(tmp_path / "n.json", json.dumps({"a": {"narration_pass_1": {"narrations": [{"timestamp_sec": 1.5, "narration_text": "x", "narration_uid": "u"}]}}, "b": {}}))
    assert [tuple(r) for r in json_files.narration_file(spark, path).collect()] == [("a", 1.5, "x", "u")]
    with pytest.raises(Exception):
        json_files.narration_file(spark, str(tmp_path / "none.json")).collect()


def test_annotation_tree_and_split(spark, tmp_path):
    path = put(tmp_path / "a.json", json.dumps(TREE))
    got = json_files.annotation_file(spark, path).collect()
    assert [(r.video_uid, r.clip_lo, r.template, r.clip_end_sec) for r in got] == [("v", 0, "t", 2), ("v", 0, None, None)]
    assert [r.video_uid for r in json_files.split_uids(spark, path).collect()] == ["v"]
    assert json_files.split_uids(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("text, n", [('[{"k":1},{"k":2}]', 2), ('{"rows":[{"k":1},{"k":NaN},]}', 2), ('{"k":1}', 1), ('{"k":1}\n\nbroken\n{"k":2,}\n', 2), ("", 0)])
def test_robust_records(spark, tmp_path, text, n):
    path = put(tmp_path / "x.json", text)
    assert json_files.robust_records(spark, path).count() == n


def test_gzip_is_read_by_suffix(spark, tmp_path):
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write('[{"video_uid":"a"},{"videoId":"b"},{"uid":"c"},{"none":1}]')
    records = json_files.robust_records(spark, str(tmp_path / "x.json.gz"))
    assert sorted(r.video_uid for r in json_files.uids(records).collect()) == ["a", "b", "c"]


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "l.jsonl", '{"video_uid":"a","clip_start_sec":NaN}\n\nbad\n{"video_uid":"b"}\n')
    good, bad = json_files.json_lines(spark, path, QUESTION)
    assert sorted(r.video_uid for r in good.collect()) == ["a", "b"]
    assert [r._bad for r in bad.collect()] == ["bad"]
    assert json_files.array_or_lines(spark, put(tmp_path / "o.json", '{"video_uid":"z"}'), QUESTION).first().video_uid == "z"


def test_flattened_questions(spark, tmp_path):
    assert json_files.flattened_questions(spark, put(tmp_path / "t.json", json.dumps(TREE))).count() == 2
    assert json_files.flattened_questions(spark, put(tmp_path / "f.json", '[{"video_uid":"a","query":"q"}]')).first().query == "q"
    with pytest.raises(ValueError):
        json_files.flattened_questions(spark, put(tmp_path / "b.json", '{"a":1}'))


def test_shards_and_features(spark, tmp_path):
    for k in (0, 2):
        put(tmp_path / f"shard_{k:04d}.jsonl", '{"a":1}\n\n{"a":2}\n')
    put(tmp_path / "u1.pt", "x")
    found = files.shards(spark, str(tmp_path))
    assert [r.shard for r in found.collect()] == [0, 2]
    assert [r.shard for r in files.missing_shards(found, 0, 3).orderBy("shard").collect()] == [1, 3]
    assert {r.file: r.n for r in files.shard_counts(spark, str(tmp_path)).collect()} == {"shard_0000.jsonl": 2, "shard_0002.jsonl": 2}
    assert [r.video_uid for r in files.present_features(spark, str(tmp_path)).collect()] == ["u1"]


def test_conversion(spark, tmp_path):
    put(tmp_path / "x.jsonl", '{"a":1}\nbad\n\n{"a":2}\n')
    written, bad = files.convert_folder(spark, str(tmp_path), out_folder=str(tmp_path / "out"))
    assert [r.out for r in written.collect()] == [f"{tmp_path}/out/x_converted.json"]
    assert json.loads((tmp_path / "out" / "x_converted.json").read_text()) == [{"a": 1}, {"a": 2}]
    assert [(r.line_no, r.line) for r in bad.collect()] == [(2, "bad")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "v", 0.0, 1.0), (2, "w", 1.0, 3.0)], "id long, video_uid string, cs double, ce double")
    sinks.write_catalog(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    sinks.reset_ledger(spark, str(tmp_path / "l"))
    sinks.append_ledger(rows.where("id = 1"), str(tmp_path / "l"))
    assert [r.id for r in sinks.unused(rows, spark.read.parquet(str(tmp_path / "l"))).collect()] == [2]
    sinks.write_document(rows, str(tmp_path / "d"))
    assert len(json.loads(spark.read.text(str(tmp_path / "d")).first().value)["videos"]) == 2
    sinks.write_audit(rows, ["id"], str(tmp_path / "a"))
    sinks.write_uid_list(rows, str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u")).collect()] == ["v", "w"]
    sinks.write_json_lines(rows, str(tmp_path / "j"), gzip=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_bucketed(rows, "bucketed_catalog", 2)
    assert spark.table("bucketed_catalog").count() == 2
    spark.sql("DROP TABLE bucketed_catalog")
