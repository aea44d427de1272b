"""Kernels, quality rules, tokenizer and token counts against plain versions."""

import base64
import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from strandweave.llm import byte_bpe, quality_rules, text_kernels, token_counts
from strandweave.llm.queries import RANKS, ranks_path

SPACE = r"[^\x20\x09-\x0D]+"
TEXTS = [None, "", " \n\t", "a", "it's  we'll \n don't!! x2 ²³ é漢  z", "one two three one two three\nx\nx\n", "A" * 3000, "word " * 4000, "'s're 'x ''s\n's", "　 á 🙂🙂\r\n#tag <b>"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def encoding():
    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_hashes_do_not_depend_on_the_block():
    texts = [t or "" for t in TEXTS]
    data, starts, ends, words = text_kernels.words_of(pa.array(texts))
    hashes = text_kernels.hash_spans(data, starts, ends)
    for i, t in enumerate(texts):
        own_data, a, b, _ = text_kernels.words_of(pa.array([t]))
        assert [bytes(own_data[x:y]).decode() for x, y in zip(a, b)] == re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert (text_kernels.hash_spans(own_data, a, b) == hashes[words[i]:words[i + 1]]).all()


def test_trim_gives_tables_back_and_hashes_stay():
    data, starts, ends, _ = text_kernels.words_of(pa.array(["some words of a text " * 5000]))
    before = text_kernels.hash_spans(data, starts, ends)
    assert sum(p.nbytes for p in text_kernels._powers) > len(data)
    text_kernels.trim()
    assert sum(p.nbytes for p in text_kernels._powers) <= 16
    assert (text_kernels.hash_spans(data, starts, ends) == before).all()


def test_memory_of_encoding_does_not_follow_the_batch(encoding):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    own = byte_bpe.Codec(ranks_path())
    got = []
    tracemalloc.start()
    for block in text_kernels.blocks(iter([batch]), size=byte_bpe.BLOCK_BYTES):
        ids, _, tokens, _ = own.encode_block(block.column(1))
        got += [ids[a:b].astype("<u2") for a, b in zip(tokens, tokens[1:])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got[:20]] == [encoding.encode_ordinary(t) for t in texts[:20]]
    assert batch.nbytes > 3 << 20 and peak < 100 << 20


def plain_rules(t):
    t = t or ""
    words = re.findall(SPACE, t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 4000]
    got = quality_rules.ledger(docs(spark, texts)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(texts[r.doc_id])
    assert all(r.failed_bits & 1 for r in got if r.n_words < 50)
    assert quality_rules.ledger(docs(spark, TEXTS).limit(0)).count() == 0


def test_policies_and_ablations(spark):
    entries = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 16)], "doc_id long, failed_bits long")
    assert [r.doc_id for r in quality_rules.apply_policy(entries).where("kept").collect()] == [1, 5]
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablations(entries).collect()}
    assert found["few_words"] == (2, 1, 3) and found["repeated_windows"] == (1, 0, 2) and found["many_symbols"] == (1, 1, 3)


def test_filter_keeps_columns(spark):
    rows = docs(spark, ["x y " * 100, " ".join(f"word{k}" for k in range(80)), None])
    kept = quality_rules.filter_documents(rows)
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1]


def test_encoding_equals_the_library(spark, encoding):
    rng = random.Random(3)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "''", " ", "  ", "\n", "\t", "1", "²", "é", "漢", "!", " ", "　", "́", "🙂", "S", "\x1c", "\x85", "\r\n"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)]
    got = {r.doc_id: r for r in byte_bpe.encode(docs(spark, texts), ranks_path()).collect()}
    digests = {r.doc_id: r for r in byte_bpe.round_trip(docs(spark, texts), ranks_path()).collect()}
    for k, t in enumerate(texts):
        want = encoding.encode_ordinary(t or "")
        assert got[k].ids == want and got[k].n_tokens == len(want)
        assert got[k].token_bytes == [len(encoding.decode_bytes(want[:i])) for i in range(len(want))] if len(want) < 200 else True
        assert digests[k].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert digests[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs(spark, TEXTS), ranks_path()), ranks_path()).collect()
    assert {r.doc_id: r.text for r in back} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_classes_of_all_code_points(encoding):
    codec = byte_bpe.Codec(ranks_path())
    for at in range(0, 0x110000, 4096):
        text = "".join(f"{chr(c)}a{chr(c)} {chr(c)}{chr(c)}1'{chr(c)}" for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000)
        assert codec.encode_block(pa.array([text]))[0].tolist() == encoding.encode_ordinary(text)


def test_the_path_is_a_parameter(spark):
    other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.encode(docs(spark, ["grün und schön"]), other).first().ids != byte_bpe.encode(docs(spark, ["grün und schön"]), ranks_path()).first().ids
    assert RANKS in ranks_path()


def plain_sections(encoding, t, rule):
    lines = (t or "").splitlines(keepends=True) if "\r" not in (t or "") else [x for x in re.findall(r"[^\n]*\n|[^\n]+", t)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", t or "") or [""]
    edges, total = [], 0
    for x in lines:
        edges.append((total, total + len(x.encode())))
        total += len(x.encode())
    counts, crossing, at = [0] * len(lines), [0] * len(lines), 0
    for token in encoding.encode_ordinary(t or ""):
        size = len(encoding.decode_single_token_bytes(token))
        held = [max(0, min(b, at + size) - max(a, at)) for a, b in edges]
        inside = [k for k, h in enumerate(held) if h]
        own = inside[0] if rule == "start" else inside[-1] if rule == "end" else max(inside, key=lambda k: (held[k], -k))
        counts[own] += 1
        crossing[own] += len(inside) > 1
        at += size
    return list(zip(counts, crossing)), [len(x) for x in lines]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_by_line(spark, encoding, rule):
    texts = [None, "", "a", "one\n\n\ntwo é漢\n", "\n\n\nx\n  y", "tail\n\n", "a b\r\n\r\n c"] + ["x \n\n\n y" * 50]
    rows = token_counts.section_counts(docs(spark, texts), ranks_path(), rule).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        want, sizes = plain_sections(encoding, t, rule)
        assert [(r.n_tokens, r.n_crossing) for r in own] == want
        assert [r.end_char - r.start_char for r in own] == sizes


def test_given_cuts(spark, encoding):
    rows = spark.createDataFrame([(1, "abcdefgh ij", [4, 4, None, -1, 99, 9]), (2, "", [1]), (3, None, None)], "doc_id long, text string, at array<int>")
    got = token_counts.section_counts(rows, ranks_path(), cuts=F.col("at")).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.start_char, r.end_char) for r in got] == [(1, 0, 4), (1, 4, 9), (1, 9, 11), (2, 0, 0), (3, 0, 0)]
    assert sum(r.n_tokens for r in got) == len(encoding.encode_ordinary("abcdefgh ij"))
    with pytest.raises(ValueError):
        token_counts.section_counts(rows, ranks_path(), "none")


def test_long_spans_do_not_collide():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data, starts, ends, _ = text_kernels.words_of(pa.array([f"{word} {other}"]))
    a, b = text_kernels.hash_spans(data, starts, ends).tolist()
    assert a != b


def test_long_slices_next_to_each_other(encoding, monkeypatch):
    codec = byte_bpe.Codec(ranks_path())
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdeé漢") for _ in range(rng.choice([150, 201, 400, 5000]))) for _ in range(30))
    texts = [text, "x" * 1000 + "1" * 1000 + "!" * 1000, text]
    for least in (byte_bpe.CACHE_BYTES, 10):
        monkeypatch.setattr(byte_bpe, "CACHE_BYTES", least)
        ids, _, tokens, _ = codec.encode_block(pa.array(texts))
        for t, a, b in zip(texts, tokens, tokens[1:]):
            assert ids[a:b].tolist() == encoding.encode_ordinary(t)
    assert codec.cached <= 10 or codec.cache
