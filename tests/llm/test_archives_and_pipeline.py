"""WARC in ZIP by round trips; queries against SQL; the pipeline against brute force."""

import base64
import hashlib
import io
import re
import struct
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
import tiktoken
from conftest import DATA
from strandweave.llm import decontamination, line_dedup, queries, warc_zip
from test_duplicates import deduped, groups, hits
from test_text_and_rules import plain_rules

TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, f"{DATA}/sf0.001")
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    found = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert list(map(repr, rows)) == list(map(repr, sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)))


def test_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a/ \r\nInjected: 1", big), (3, "u", big), (3, "u", big), (7, None, big), (8, "v", "short"), (9, "v", "short"), (10, "w", None), (None, "n", big), (11, "r\r\n\r\n", "\r\n\r\nWARC/1.1" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    archives = warc_zip.write_archives(warc_zip.with_revisits(pages), f"file://{tmp_path}/w", archive_bytes=400)
    assert archives.agg(F.sum("n_records")).first()[0] == len(rows)
    got = warc_zip.read_archives(archives, read_bytes=300).collect()
    assert len(got) == len(rows)
    payloads = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        page = None if r.page is None else int(r.page)
        body = payloads[page]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.record_type == ("revisit" if body == big.encode() and page != 3 else "response")
        assert r.refers_to == ("3" if r.record_type == "revisit" else None)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert next(r.url for r in got if r.page == "7") is None


def test_large_shares_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "small", lambda df, rows=0: df)
    pages = spark.createDataFrame([(k, "u", "y" * 150 if k % 3 else f"{k}" * 100) for k in range(60)], "page_id long, url string, html string")
    got = {r.page: r.refers_to for r in warc_zip.with_revisits(pages).collect()}
    assert got == {k: (1 if k % 3 and k != 1 else None) for k in range(60)}


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc_zip.write_archives(warc_zip.with_revisits(none), f"file://{tmp_path}/w")
    assert warc_zip.read_archives(archives).count() == 0


def _zip64(members: dict[str, bytes]) -> bytes:
    """A ZIP whose central directory puts every size and place into ZIP64 fields, and with a ZIP64 end record."""
    out, central = io.BytesIO(), b""
    for name, data in members.items():
        at = out.tell()
        out.write(struct.pack("<IHHHHHIIIHH", warc_zip.LOCAL, 45, 0, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(name), 3) + name.encode() + b"abc" + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        extra = struct.pack("<HH", 0x5455, 0) + extra
        central += struct.pack("<IHHHHHHIIIHHHHHII", warc_zip.CENTRAL, 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
    start = out.tell()
    out.write(central)
    end = out.tell()
    out.write(struct.pack("<IQHHIIQQQQ", warc_zip.END_64, 44, 45, 45, 0, 0, len(members), len(members), len(central), start))
    out.write(struct.pack("<IIQI", warc_zip.LOCATOR_64, 0, end, 1))
    out.write(struct.pack("<IHHHHIIH", warc_zip.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"hello")
    return out.getvalue()


def test_zip64_directories():
    members = {"a": b"first", warc_zip.WARC_MEMBER: b"x" * 1000}
    data = _zip64(members)
    found = warc_zip.ZipDirectory(io.BytesIO(data), len(data))
    for name, want in members.items():
        at, size = found.stored(name)
        assert data[at:at + size] == want


def test_plain_zip_and_refusals():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
    found = warc_zip.ZipDirectory(out, len(out.getvalue()))
    at, size = found.stored("s")
    assert out.getvalue()[at:at + size] == b"stored"
    with pytest.raises(ValueError):
        found.stored("d")
    with pytest.raises(ValueError):
        warc_zip.ZipDirectory(io.BytesIO(b"none"), 4)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0)], rows.schema)
    rows.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(r.doc_id, r.text) for r in rows.collect()]

    def clean(t):
        n, chars, symbols, _, repeats = plain_rules(t)
        letters = re.findall("[A-Za-z]", t or "")
        return n >= 50 and 100 * repeats <= 50 * n and 10 * symbols <= n and 2 * n <= chars <= 20 * n and 10 * sum(x < "a" for x in letters) <= 6 * len(letters)

    docs = [(d, t) for d, t in docs if clean(t)]
    lines = deduped(docs, 4, 5)
    docs = [(d, lines[d][0]) for d, _ in docs if not lines[d][1] or lines[d][0].strip(" \t\n\x0b\f\r")]
    docs = [(d, t) for (d, t), (e, _, c) in zip(sorted(docs), groups(sorted(docs), 5, 4, 5), strict=True) if d == c]
    items = [(r.item_id, r.text) for r in bench.collect()]

    def contaminated(t):
        n, hit, _ = hits(t, items, 13)
        return hit > 0 and 20 * hit >= n

    docs = [(d, t) for d, t in docs if not contaminated(t)]
    with open(queries.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d, len(ids := encoding.encode_ordinary(t)), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert decontamination.contaminated() is not None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_odd_tables(spark):
    schema = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").schema
    text = " ".join(f"word{k}" for k in range(60))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, "en", "s", 9), (2, text, "en", "s", 9), (None, text, "en", "s", 9)], schema).withColumn("h", F.lit("clash"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, f"{DATA}/sf0.001")
            assert got.columns == docs.columns, name
            got.collect()
    kept = corpus_pipeline.by_ngram_jaccard(spark, odd, "").collect()
    assert sum(r.doc_id == 2 for r in kept) == 1


def test_decontamination_judges_rows_of_null_and_repeated_ids(spark):
    folder = f"{DATA}/sf0.001"
    item = max((r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()), key=len)
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    clean = "nothing of a benchmark is here"
    docs = spark.createDataFrame([(d, t, "en", "s", 9) for d in (None, 4) for t in (item, clean)] + [(5, item, "en", "s", 9)], schema)
    assert sorted((repr(r.doc_id), r.text) for r in corpus_pipeline.by_decontamination(spark, docs, folder).collect()) == [("4", clean), ("None", clean)]


def test_no_row_is_lost_for_a_repeated_id(spark):
    schema = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").schema
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a, "en", "s", 9), (1, b, "en", "s", 9), (2, f"q {a}", "en", "s", 9), (None, b, "en", "s", 9), (None, "c " * 3 + "d", "en", "s", 9)], schema)
    got = corpus_pipeline.by_ngram_jaccard(spark, docs, "").collect()
    assert sorted((repr(r.doc_id), r.text) for r in got) == sorted([("1", a), ("1", b), ("None", "c c c d")])


def test_a_clashing_count_column(spark):
    schema = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").schema
    docs = spark.createDataFrame([(1, "one two\nthree", "en", "s", 9), (2, "four\none two", "en", "s", 9)], schema).withColumn("n_lines_removed", F.lit("own"))
    got = corpus_pipeline.by_line_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars, r.n_lines_removed) for r in got.collect()) == [(1, "one two\nthree", 9, "own"), (2, "four", 4, "own")]
    assert line_dedup.dedup(docs).columns == [*docs.columns, "n_lines_removed_"]


def test_zip_comments_that_look_like_end_records():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.comment = b"PK\x05\x06 is no end record, nor is PK\x05\x06" + bytes(18) + b"."
    found = warc_zip.ZipDirectory(out, len(out.getvalue()))
    at, size = found.stored("s")
    assert out.getvalue()[at:at + size] == b"stored"


def test_page_ids_with_line_breaks(spark, tmp_path):
    body = "<p>" + "y" * 200
    pages = spark.createDataFrame([("a\r\nWARC-Type: none", "u", body), ("b%0A\u00e9", "u", body)], "page_id string, url string, html string")
    archives = warc_zip.write_archives(warc_zip.with_revisits(pages), f"file://{tmp_path}/w")
    got = {r.page: (r.record_type, r.refers_to) for r in warc_zip.read_archives(archives).collect()}
    assert got == {"a\r\nWARC-Type: none": ("response", None), "b%0A\u00e9": ("revisit", "a\r\nWARC-Type: none")}
