"""Near duplicates, line dedup and decontamination against brute force."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import decontamination, fm_index, line_dedup, ngram_jaccard, shared

SPACE = r"[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(docs, n, p, q):
    def shingles(t):
        w = re.findall(SPACE, low(t))
        return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(docs):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((d, len(sets[i]), lowest[find(i)]) for i, (d, _) in enumerate(docs))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [rng.choice("abcdefghij") + str(rng.randrange(6)) for _ in range(rng.choice([2, 5, 8, 12, 20, 40, 80, 150]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            own = list(words)
            for _ in range(rng.randrange(max(2, len(words) // 25))):
                own[rng.randrange(len(own))] = "zz" + str(rng.randrange(1000))
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One")]


@pytest.mark.parametrize("n, p, q, group_bytes", [(4, 85, 100, ngram_jaccard.GROUP_BYTES), (5, 4, 5, ngram_jaccard.GROUP_BYTES), (5, 4, 5, 2000)])
def test_components(spark, corpus, n, p, q, group_bytes):
    rows = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, ngram_jaccard.components(rows, n, p, q, group_bytes=group_bytes).collect())) == groups(corpus, n, p, q)


def test_components_of_odd_tables(spark):
    assert ngram_jaccard.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard.components(rows).collect()), key=repr)
    assert got == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (None, 0, None)], key=repr)
    named = spark.createDataFrame([("b", "a b c d e f g"), ("a", "a b c d e f g")], "id string, body string")
    assert {tuple(r) for r in ngram_jaccard.components(named, id_col="id", text_col="body").collect()} == {("a", 3, "a"), ("b", 3, "a")}


@pytest.mark.parametrize("p, q, least, most", [(85, 100, 4, 120), (4, 5, 1, 60), (3, 4, 2, 120), (3, 4, 300, 500), (7, 10, 1, 120), (1, 2, 1, 60), (3, 10, 1, 30)])
def test_part_hashes_lose_no_link(p, q, least, most):
    import numpy as np

    rng = random.Random(1)
    bands = ngram_jaccard.Bands(p, q)
    for _ in range(600 if most < 300 else 60):
        pool = [rng.randrange(1 << 64) for _ in range(most + 30)]
        a = set(pool[:rng.randrange(least, most)])
        b = set(a)
        for _ in range(rng.randrange(20 if most < 300 else 130)):
            last = b - {rng.choice(sorted(b))} if rng.random() < 0.5 else b | {rng.choice(pool)}
            if q * len(a & last) < p * len(a | last):
                break
            b = last
        hashes = [set(bands.part_hashes(np.array(sorted(s), np.uint64), np.array([0, len(s)]))[0].tolist()) for s in (a, b)]
        assert a == b or hashes[0] & hashes[1]


def test_components_with_a_shared_passage(spark, corpus):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = corpus + [(20_000 + k, f"{passage} " + " ".join(f"w{k}x{j}" for j in range(3 + k))) for k in range(25)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_jaccard.components(rows, 5, 4, 5, group_bytes=4000, tile=3).collect())) == groups(docs, 5, 4, 5)


def test_components_of_boilerplate_and_near_misses(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    docs = []
    for k in range(60):  # variants of one text, about the threshold; many link only through others
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        docs.append((k, " ".join(own)))
    lines = [" ".join(f"l{j}w{k}" for k in range(9)) for j in range(12)]
    docs += [(100 + k, " ".join(rng.sample(lines, rng.randrange(1, 5)) + [f"own{k}"] * rng.randrange(2))) for k in range(80)]
    docs += [(300 + k, " ".join(f"s{rng.randrange(3)}" for _ in range(rng.randrange(1, 14)))) for k in range(120)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for n, p, q in ((5, 4, 5), (1, 4, 5)):
        assert sorted(map(tuple, ngram_jaccard.components(rows, n, p, q, tile=5).collect())) == groups(docs, n, p, q)


@pytest.mark.parametrize("p, q", [(3, 4), (1, 2)])
def test_components_at_low_thresholds(spark, corpus, p, q):
    """Where cuts need more spare bundles, and where shingles meet one by one; tiny sets too."""
    rng = random.Random(4)
    docs = corpus[:60] + [(1000 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))) for k in range(60)]
    base = [f"b{k}" for k in range(260)]
    docs += [(2000 + k, " ".join(w if rng.random() > 0.05 + k / 150 else f"x{rng.randrange(99)}" for w in base)) for k in range(12)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_jaccard.components(rows, 1, p, q).collect())) == groups(docs, 1, p, q)


def test_a_set_that_no_cut_suits_is_an_error():
    import numpy as np

    bands = ngram_jaccard.Bands(4, 5)
    bands.spare = bands.spare - 100
    with pytest.raises(RuntimeError, match="suit none"):
        bands.part_hashes(np.arange(1, 31, dtype=np.uint64) << np.uint64(50), np.array([0, 30]))


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 300), (5, 5)]
    got = shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def deduped(docs, p, q):
    out, before = {}, []
    for d, t in sorted(docs):
        keep, gone = [], 0
        for line in (t or "").split("\n"):
            w = [x for x in re.split(r"[ \t\x0b\f\r]+", line.lower()) if x]
            s = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            hit = bool(s) and any(q * len(s & y) >= p * len(s | y) for y in before)
            if s:
                before.append(s)
            keep += [] if hit else [line]
            gone += hit
        out[d] = (None if t is None else "\n".join(keep), gone)
    return out


@pytest.mark.parametrize("look_back", [6, 1])
def test_line_dedup(spark, monkeypatch, look_back):
    monkeypatch.setattr(line_dedup, "LOOK_BACK", look_back)
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 60]))] for _ in range(40)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.randrange(max(2, len(words) // 6))):
            words[rng.randrange(len(words))] = "m" + str(rng.randrange(500))
        text = rng.choice([" ", "  ", "\t"]).join(words)
        return text.upper() if rng.random() < 0.1 else text

    docs = [(k, "\n".join(line() for _ in range(rng.randrange(8)))) for k in range(90)] + [(500, None), (501, ""), (502, " \n\n "), (503, "x")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed_", F.lit(1)).withColumn("doc", F.lit("c")).repartition(3)
    got = line_dedup.dedup(rows)
    assert got.columns == [*rows.columns, "n_lines_removed"]
    assert {r.doc_id: (r.text, r.n_lines_removed) for r in got.collect()} == deduped(docs, 4, 5)
    assert line_dedup.dedup(rows.limit(0)).count() == 0
    plan = line_dedup.dedup(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A  b c\nd")], "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.text) for r in line_dedup.dedup(rows).collect()) == [("1", ""), ("1", ""), ("2", "d"), ("None", "a b c")]
    with pytest.raises(ValueError):
        line_dedup.dedup(rows, 1, 1)


def test_line_dedup_judges_each_row_of_null_and_repeated_ids(spark):
    texts = ["x\ny", "z\nx", "first\nx", "first\nv\ny", "u\nt", "u\nt"]
    docs = [(d, t) for d in (None, 7) for t in [*texts, f"own of {d}\nfirst"]] + [(8, "t\nw")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in rows.select("text", F.xxhash64("text").alias("h")).collect()}
    before, want = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        kept = [line for line in t.split("\n") if line not in before]
        want.append((repr(d), "\n".join(kept), len(t.split("\n")) - len(kept)))
        before |= set(t.split("\n"))
    got = line_dedup.dedup(rows).collect()
    assert sorted((repr(r.doc_id), r.text, r.n_lines_removed) for r in got) == sorted(want)
    assert sorted(line for r in got if r.text for line in r.text.split("\n")) == sorted(before)


def test_line_dedup_exchanges_only_sets_of_pairs(spark):
    held = spark.createDataFrame([(k, (k, 0), [k, k + 1]) for k in range(20)], "h long, first struct<doc:long,line_no:int>, s array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 5)], "x long, y long")
    assert sorted((r.h, r.s) for r in line_dedup._sets_of(held, pairs).collect()) == [(1, [1, 2]), (2, [2, 3]), (5, [5, 6])]


def test_line_dedup_drops_keys_that_no_similar_pair_meets_at(spark):
    rows = [(1, h, 50, i) for h, i in ((10, 8), (11, 9))] + [(2, 10, 50, 8), (2, 12, 50, 5)] + [(3, 13, 50, 0)]
    met = line_dedup._met(spark.createDataFrame(rows, "key long, h long, n int, i int"), 4, 5)
    assert sorted(map(tuple, met.select("key", "h", "n", "i", "met").collect())) == [(2, 10, 50, 8, 2), (2, 12, 50, 5, 2)]


def test_line_bitmaps(spark):
    rng = random.Random(5)
    sets = [sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)}) for n in (0, 1, 3, 40)] + [[-(1 << 63), -(1 << 62), 0, 1 << 62]]
    got = line_dedup._bits(spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "h long, s array<long>")).collect()
    for r in got:
        words = [0] * 4
        for x in sets[r.h]:
            words[(x >> 62) + 2] |= 1 << (x & 63)
        assert [w % (1 << 64) for w in (r.m0, r.m1, r.m2, r.m3)] == words


@pytest.mark.parametrize("look_back", [6, 1])
def test_line_dedup_on_word_sets(spark, monkeypatch, look_back):
    monkeypatch.setattr(line_dedup, "LOOK_BACK", look_back)
    rng = random.Random(7)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice([1, 3, 5, 9, 10, 14, 25]))] for _ in range(30)]
    lines, docs, before = [], {}, []
    for _ in range(250):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "m" + str(rng.randrange(99))
        lines.append(" ".join(words))
    for k in range(0, 250, 5):
        kept = []
        for line in lines[k:k + 5]:
            s = set(line.split())
            kept += [] if any(5 * len(s & y) >= 4 * len(s | y) for y in before) else [line]
            before.append(s)
        docs[k] = ("\n".join(kept), 5 - len(kept))
    rows = spark.createDataFrame([(k, "\n".join(lines[k:k + 5])) for k in docs], "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.dedup(rows, shingle=1).collect()} == docs


def test_fm_index():
    import numpy as np

    rng = random.Random(2)
    for _ in range(60):
        text = np.array([rng.randrange(4) for _ in range(rng.randrange(2, 80))] + [0])
        index = fm_index.FMIndex(text, 5)
        patterns = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 4))] for _ in range(12)]
        matrix = np.array([p + [0] * (3 - len(p)) for p in patterns])
        lows, highs = index.search(matrix, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, lows, highs):
            want = [k for k in range(len(text) - len(p) + 1) if text[k:k + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def hits(text, items, window):
    words, hit, found = decontamination.words(text), set(), set()
    for item, t in items:
        own = decontamination.words(t)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            p = own[k:k + window]
            for a in range(len(words) - len(p) + 1):
                if words[a:a + len(p)] == p:
                    found.add(item)
                    hit |= set(range(a, a + len(p)))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limits", [{}, {"part_bytes": 20}, {"max_bytes": 40}])
def test_decontamination(spark, limits):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice(["a", "B", "é", "x1", "zz", "the"]) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    items = [(k, make(rng.randrange(9))) for k in range(6)] + [(2, make(5)), (9, None)]
    docs = [(k, make(rng.randrange(40)) + rng.choice([" q ", ""]) + rng.choice(items[:6])[1]) for k in range(25)] + [(90, None), (91, ""), (91, ""), (92, "!!")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)).withColumn("n_hit", F.lit("c"))
    test = spark.createDataFrame([*items, (None, "the the the")], "item_id long, text string")
    got = decontamination.search(rows, test, window=4, **limits).collect()
    key = lambda x: (x[0], x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=key) == sorted(((d, *hits(t, items, 4)[:2], tuple(hits(t, items, 4)[2])) for d, t in docs), key=key)
    texts = dict(docs)
    for r in got:
        assert sum(s.end_word - s.first_word for s in r.spans) == r.n_hit
        for s in r.spans:
            assert len(decontamination.words(texts[r.doc_id][s.start_char:s.end_char])) == s.end_word - s.first_word


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontamination.search(docs, none).collect()] == [(2, 0, [])]
    assert decontamination.search(docs.limit(0), none).count() == 0


def test_merge_of_touching_spans():
    import numpy as np

    a, b = decontamination._merge(np.array([5, 0, 3]), np.array([7, 3, 5]))
    assert (a.tolist(), b.tolist()) == ([0], [7])
    assert isinstance(pa.array(a), pa.Array)


def test_decontamination_by_text_ids(spark):
    items = spark.createDataFrame([("i\n2", "one two three"), ("i1", "four"), ("i1", "five six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "ONE two three, four"), (2, "five six"), (3, "five")], "doc_id long, text string")
    for limits in ({}, {"part_bytes": 5}, {"part_bytes": 5, "max_bytes": 5}):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.search(docs, items, **limits).collect()}
        assert got == {1: (4, ["i\n2", "i1"]), 2: (2, ["i1"]), 3: (0, [])}


def test_phrases_are_small():
    import pickle

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(300)) for _ in range(500)]
    made = decontamination.Phrases(pa.array(range(500)), pa.array(texts), 13)
    assert len(made.starts) == 500 * 288 and len(pickle.dumps(made)) < 10 * sum(map(len, texts))
