"""The structural scan against a reader that sees each document whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandweave.sources import json_files, json_scan
from strandweave.schemas import QUESTION


@pytest.fixture
def ranges(spark):
    """Byte ranges of a few bytes, so that every value lies across some."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_reader(spark, path):
    """(file, record as JSON): each file as one text, parsed whole, else repaired, else by lines."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    whole = raw.withColumn("v", F.when(F.ltrim("value").rlike(r"^\s*[\[{]"), json_files.parsed(F.col("value"))))
    lists = [F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in json_files.WRAPPER_KEYS]]
    good = whole.where("v IS NOT NULL").select("file", F.explode(F.coalesce(*lists, F.array("v"))).alias("record"))
    lines = whole.where("v IS NULL").select("file", F.explode(F.split("value", r"\r?\n")).alias("line")).where(F.trim("line") != "")
    return good.unionByName(lines.select("file", json_files.parsed(F.col("line")).alias("record")).where("record IS NOT NULL")).select("file", F.to_json("record").alias("record"))


WORDS = ["a,b", 'say "x"', "back\\slash", "\\", "brackets ]}[{", "ünï", "", "line\nend", '","', "tail\\\\\""]


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rnd.choice(WORDS)
    if kind < 4:
        return rnd.choice([1, -2.5, True, None, 10**12])
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["k", "clips", "a,b", "x y", "rows"]) + str(i): value(rnd, depth + 1) for i in range(rnd.randrange(4))}


def document(rnd):
    records = [value(rnd) for _ in range(rnd.randrange(6))]
    shape = rnd.randrange(5)
    if shape < 2:
        return records
    body = {"meta": value(rnd), rnd.choice(["clips", "rows", "items", "others"]): records, "after": value(rnd)}
    if shape == 3:
        body["data"] = [value(rnd)]
    return body if shape < 4 else {"id": value(rnd), "deep": {"clips": records}}


def broken(rnd, text):
    at = rnd.randrange(len(text) + 1)
    return rnd.choice([
        lambda: text, lambda: text, lambda: text.replace("]", ",]", 1), lambda: text.replace("}", " , }", 1), lambda: text.replace("-2.5", "NaN"), lambda: text.replace("true", "-Infinity"), lambda: text[:at], lambda: text + ",", lambda: text + "\n", lambda: f"  \n{text}",
        lambda: text + " x", lambda: text + text, lambda: text + "\n" + text, lambda: text[:at] + rnd.choice('",[]{}\\x\x07') + text[at:], lambda: text.replace(",", ",,", 1), lambda: text.replace("}", "]", 1), lambda: "x" + text, lambda: text + "]",
    ])()


def test_equals_the_whole_reader_on_sound_and_broken_documents(spark, tmp_path, ranges):
    rnd = random.Random(11)
    for k in range(90):
        text = json.dumps(document(rnd), indent=rnd.choice([None, None, 2]), ensure_ascii=rnd.random() < 0.5)
        (tmp_path / f"{k:03}.json").write_text(broken(rnd, text))
    for k, text in enumerate(["", " ", "[]", "{}", "[,]", "[1,]", "{,}", '{"a":1,}', '{"clips":[]}', '{"clips":{"a":[1]}}', '{"clips":[1],"rows":[2]}', '{"rows":[2],"clips":[1,]}', "[[1,2],[3]]", "[1],", "[1]]", "]", "[1}", '{"clips":[1}}', '{"clips":[1],"clips2":[2],x}', "[\"a", "5", '"x"', '[{"a":[1,{"b":"]"}]}]', '{"a":1}\n{"a":2}\n', "[1]\n[2]"]):
        (tmp_path / f"t{k:02}.json").write_text(text)
    got = sorted((r["file"], r["record"]) for r in json_files.robust_records(spark, str(tmp_path)).select("file", F.to_json("record").alias("record")).collect())
    want = sorted((r["file"], r["record"]) for r in whole_reader(spark, str(tmp_path)).collect())
    wrong = {f for f, _ in set(got) ^ set(want)}
    assert got == want, [(f, (tmp_path / f.rpartition("/")[2]).read_text(), [r for g, r in got if g == f], [r for g, r in want if g == f]) for f in sorted(wrong)[:6]]


def test_ranges_are_many_and_parts_keep_their_order(spark, tmp_path, ranges):
    rows = [{"k": i, "text": "x, " * (i % 30), "inner": [i, {"y": "]"}]} for i in range(70)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"before": [1, 2], "videos": rows, "last": {"a": 1}}))
    found, files = json_scan.parts(spark, str(tmp_path), ("videos",))
    assert [r["sound"] for r in files.collect()] == [True, True]
    assert json_scan._pieces(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
    for name, key in (("a.json", ""), ("b.json", "videos")):
        own = found.where(F.col("file").endswith(name) & (F.col("key") == key)).orderBy("block", "nth").collect()
        assert [json.loads(r["text"]) for r in own] == rows
        assert [r["opened"] for r in own] == [True] + [False] * 69 and [r["closed"] for r in own] == [False] * 69 + [True]
    members = found.where(F.col("file").endswith("b.json") & (F.col("key") == "")).orderBy("block", "nth").collect()
    assert [json.loads("{" + r["text"] + "}") for r in members] == [{"before": [1, 2]}, {"last": {"a": 1}}]


def test_one_record_longer_than_many_ranges(spark, tmp_path, ranges):
    record = {"text": "long, " * 900, "list": list(range(200))}
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, record, {"k": 2}]))
    assert sorted(len(r["record"]) for r in json_files.robust_records(spark, str(tmp_path)).select(F.to_json("record").alias("record")).collect()) == sorted(len(json.dumps(x, separators=(",", ":"))) for x in [{"k": 1}, record, {"k": 2}])


def test_array_or_lines_of_each_shape(spark, tmp_path, ranges):
    for name, text in {"a": '[{"video_uid": "a"}, {"video_uid": "b"}]', "o": '{"video_uid": "c", "clips": [1]}', "l": '{"video_uid": "d"}\nbad\n{"video_uid": "e"}', "x": '[{"video_uid": "f"},]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r["video_uid"] for r in json_files.array_or_lines(spark, str(tmp_path), QUESTION).collect()) == ["a", "b", "c", "d", "e"]
