"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from conftest import DATA
from strandweave.llm import queries, token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {}
    for b in range(256):
        letter[chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b)))] = b

    def tokens(text):
        """(id, bytes) of both sides, none if they don't spell the text."""
        if not text:
            return [], []
        x = [(i, bytes(letter[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in two.encode(text):
            p = two.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else ([], [])

    def groups(text):
        x, y = tokens(text)
        ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) if side else set() for side in (x, y)]
        out, at = [], [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            group = []
            for k, side in enumerate((x, y)):
                own, size = [], sum(len(t) for _, t in side[:0])
                size = sum(len(t) for _, t in side[:at[k]])
                while size < cut:
                    own.append(side[at[k]][0])
                    size += len(side[at[k]][1])
                    at[k] += 1
                group.append(own)
            out.append(group)
        return out

    def report(rows):
        found = [(key, groups(text)) for key, text in rows]
        count, best = Counter(), defaultdict(int)
        for _, g in found:
            count.update({(a, b) for x, y in g for a in x for b in y})
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        out = []
        for key, g in found:
            links = [(a, b) for x, y in g for a in x for b in y]
            spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
            out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), spelled))
        return sorted(out, key=repr)

    return report


def test_op12_equals_brute_force(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(k, t) for k, t in rows if t is None or len(t) < 20_000]
    frame = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("text IS NULL OR length(text) < 20000")
    got = ta.align(frame, ta.Tokenizer("byte_level", A), ta.Tokenizer("pieces", B))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_whole_table(spark):
    got = queries.queries()["op12_token_alignment"](spark, f"{DATA}/sf0.001").collect()
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["groups"] for r in ta.align(docs, ta.Tokenizer("byte_level", A), ta.Tokenizer("pieces", B)).collect()}
    assert {r["doc_id"]: r["groups_sha256"] for r in got} == {k: hashlib.sha256(g.encode()).hexdigest() if g else "" for k, g in found.items()}
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(0 <= r["n_best"] <= r["n_links"] <= r["count_sum"] or not r["n_links"] for r in got) and any(r["n_best"] < r["n_links"] for r in got)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "<|endoftext|> and <s> </s> <unk> <0x41>"), (6, "Ünïcödé ß 日本語テキスト 😀 é"), (7, "tab\tand\nnew\r\nline\x00end"), (8, "a▁b"), (9, "x" * 5000), (10, "!?" * 900 + " " * 300),
    (11, "plain words here"), (11, "plain words here"), (None, "plain words there"), (13, "﻿mark   　 blank"), (14, "ａｂｃ ﬁ ①"),
]


def test_odd_texts(spark, plain, monkeypatch):
    monkeypatch.setattr(ta, "PLAIN_LINKS", 3)
    monkeypatch.setattr(ta, "BUCKET_PAIRS", 50)
    monkeypatch.setattr(ta, "UNIT_BYTES", 2000)
    frame = spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(3).withColumn("key", F.lit(1)).withColumn("unit", F.lit("x")).withColumn("a", F.lit(None).cast("string"))
    got = ta.align(frame, ta.Tokenizer("byte_level", A), ta.Tokenizer("pieces", B))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(ODD)
    assert ta.align(spark.createDataFrame([], "doc_id bigint, text string"), ta.Tokenizer("byte_level", A), ta.Tokenizer("pieces", B)).count() == 0


def test_words_in_texts_are_encoded_as_whole_texts_are(spark, plain):
    """The cut at single spaces changes nothing: the same with runs of whole texts."""
    vocabularies = ta.byte_level(A), ta.pieces(B)
    assert all(v.by_words for v in vocabularies)
    words, whole = ta.Encoder(*vocabularies), ta.Encoder(*vocabularies)
    whole.by_words = False
    texts = [t for _, t in ODD if t] + ["a  b", " a b", "a b ", "a\u0301 \u0301b c", "it 's don 't", "1 2 34", "x\u00a0y z", "the the the", "_ _ a_ _b"]
    for text in texts:
        got = []
        for encoder in (words, whole):
            number, _ = encoder([text])
            own = encoder.runs.take(number)
            got.append((own.a.tolist(), own.b.tolist(), own.n.tolist(), own.k.tolist()))
        assert got[0] == got[1], text


def test_one_other_letter_does_not_slow_the_words_beside_it(monkeypatch):
    """Words of Latin letters go the quick way whatever stands among them, and come out the same."""
    one, two = ta.Tokenizer("byte_level", A).load(), ta.Tokenizer("pieces", B).load()
    assert ta.Tokenizer("byte_level", A).load() is one  # once in a worker
    texts = ["plain words", "it's naïve  don't\t 12 ab12'll", "<|endoftext|> of", "\u00a0a \u0085b \x1c c"]
    assert "_by_ranks" in one.quick.__qualname__  # special tokens in the vocabulary don't rule it out
    assert [one.quick(t) for t in texts] == one.encode(texts)
    quick = []
    encoder = ta.Encoder(replace(one, quick=lambda text: quick.append(text) or one.quick(text)), two)
    text = " ".join(f"w{k} \u65e5{k}" for k in range(50))
    number, _ = encoder([text])
    assert sorted(" ".join(quick).split()) == sorted(f"w{k}" for k in range(50))
    own = encoder.runs.take(number)
    assert own.a.tolist() == one.encode([text])[0] and own.b.tolist() == two.encode([text])[0]


@pytest.mark.parametrize("seed", range(5))
def test_ranks_and_cuts(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 700))
    a, b = (np.unique(np.append(rnd.integers(1, n + 1, n // 3), n)) for _ in range(2))
    after, to_a, to_b = ta.shared_groups(a, b, n)
    assert after.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert to_a.tolist() == [int((a <= c).sum()) for c in after] and to_b.tolist() == [int((b <= c).sum()) for c in after]


def test_spelling_of_groups():
    runs = ta.Runs(*[np.array(x) for x in ([1, 2, 3, 7], [0, 3, 3, 4], [4, 5, 6, 8], [0, 3, 3, 4], [2, 1, 1], [1, 2, 1], [0, 2, 2, 3])], np.ones(3, bool))
    assert ta.spelled_groups(runs) == [b"1,2|4;3|5,6", b"", b"7|8"]
