"""The command line on small files."""

import json

from strandweave.__main__ import main


def test_catalog_and_conversion(spark, tmp_path, capsys):
    lines = [{"timestamp_sec": float(t), "narration_text": f"x {t}" if t != 2 else "#unsure", "narration_uid": str(t)} for t in range(6)]
    (tmp_path / "n.json").write_text(json.dumps({v: {"narration_pass_1": {"narrations": lines}} for v in ("a", "b")}))
    (tmp_path / "s.json").write_text(json.dumps({"videos": [{"video_uid": "b"}]}))
    base = ["catalog", "--narrations", str(tmp_path / "n.json"), "--split", str(tmp_path / "s.json"), "--split", str(tmp_path / "none.json")]
    main([*base, "--out", str(tmp_path / "c")])
    main([*base, "--out", str(tmp_path / "g"), "--geom-only"])
    sure, every = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "g"))
    assert {r.video_uid for r in every.collect()} == {"a"} and 0 < sure.count() < every.count()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.jsonl").write_text('{"a":1}\n')
    main(["convert", "--dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")])
    assert "l_converted.json" in capsys.readouterr().out


def test_from_clean_records_to_the_export(spark, tmp_path, capsys):
    said = [{"timestamp_sec": float(t), "narration_text": f"C lifts box {t}", "narration_uid": str(t)} for t in range(8)]
    record = {"video_uid": "a", "clip_start_sec": 0, "clip_end_sec": 8, "query_start_sec": 1, "query_end_sec": 4, "matched_template": "Objects: What X is Y?", "narrations": said, "context_text": "x"}
    lines = [json.dumps({**record, "query_end_sec": e}) for e in (4, 5, 1.05)] + ["{broken"]
    (tmp_path / "flat.jsonl").write_text("\n".join(lines))
    main(["clean", "--input", str(tmp_path / "flat.jsonl"), "--out", str(tmp_path / "shards"), "--shard-rows", "1"])
    assert capsys.readouterr().out.splitlines() == ["2\tok", "1\tquery_too_short"]
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1"]
    main(["generate", "--input", str(tmp_path / "shards"), "--out", str(tmp_path / "made")])
    made = spark.read.json(str(tmp_path / "made" / "questions"))
    assert made.count() >= 1 and all(r.query.startswith("What") and r.query.endswith("?") for r in made.collect())
    assert spark.read.csv(str(tmp_path / "made" / "audit"), header=True).count() == 2
    main(["merge", "--input", str(tmp_path / "made" / "questions"), "--out", str(tmp_path / "merged")])
    main(["export", "--input", str(tmp_path / "merged"), "--out", str(tmp_path / "tree")])
    tree = spark.read.json(str(tmp_path / "tree")).collect()
    assert [r.video_uid for r in tree] == ["a"] and len(tree[0].clips) == 1


def test_allocation_by_duration_alone(spark, tmp_path):
    said = [{"timestamp_sec": float(t), "narration_text": f"x {t}", "narration_uid": str(t)} for t in range(0, 60)]
    (tmp_path / "n.json").write_text(json.dumps({"a": {"narration_pass_1": {"narrations": said}}}))
    query = {"template": "t", "clip_start_sec": 2.0, "clip_end_sec": 3.0}
    (tmp_path / "t.json").write_text(json.dumps({"videos": [{"video_uid": "z", "clips": [{"clip_start_sec": 0, "clip_end_sec": 10, "video_start_sec": 0, "annotations": [{"language_queries": [query]}]}]}]}))
    main(["catalog", "--narrations", str(tmp_path / "n.json"), "--out", str(tmp_path / "c")])
    main(["allocate", "--catalog", str(tmp_path / "c"), "--narrations", str(tmp_path / "n.json"), "--annotations", str(tmp_path / "t.json"), "--out", str(tmp_path / "p"), "--total", "3", "--geom-only"])
    placed = spark.read.parquet(str(tmp_path / "p")).collect()
    assert placed and all(r.template == "" and r.clip_ce <= 64.0 and r.clip_cs >= 0 and abs(r.qe - r.qs - 1.0) < 0.2 for r in placed)
