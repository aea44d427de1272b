"""Language model against plain arithmetic; classifiers on held-out rows."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from strandweave.llm import backoff_lm, boosting, labelled, quality_fm, queries, text_kernels, toxicity


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


class PlainModel:
    """Counts in dictionaries; states are suffixes of what was read, failure drops the first word."""

    def __init__(self, train, order):
        self.order = order
        self.counts = [collections.Counter() for _ in range(order + 1)]
        for t in train:
            read = ["<s>", *t]
            for i in range(1, len(read)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        self.counts[n][tuple(read[i - n + 1:i + 1])] += 1
        self.words = self.counts[1]
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.contexts = [{}] + [{g: k for g, k in self.counts[n].items() if g[-1] is not None and (n == 1 or k >= 2)} for n in range(1, order)]
        self.contexts[1][("<s>",)] = len(train)
        self.share = {}
        for n in range(1, order):
            arcs = {g: k for g, k in self.counts[n + 1].items() if g[:-1] in self.contexts[n]}
            n1, n2 = (sum(x == k for x in arcs.values()) for k in (1, 2))
            d = n1 / (n1 + 2 * n2) if n1 else 0.75
            types, total = collections.Counter(self.contexts[n][g[:-1]].bit_length() for g in arcs), collections.Counter()
            for k in self.contexts[n].values():
                total[k.bit_length()] += k
            for k in total:
                self.share[n, k] = min(1, max(1e-4, d * types[k] / total[k]))

    def weight(self, state, w):
        if not state:
            return (self.words[(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        n, h = len(state), self.contexts[len(state)].get(state, 0)
        s = self.share.get((n, h.bit_length()), 1.0) if h else 1.0
        below = self.weight(state[1:], w)
        seen = self.counts[n + 1][(*state, w)]
        return (1 - s) * seen / h + s * below if seen and h else s * below

    def score(self, t):
        state, out = ("<s>",), 0.0
        for w in t:
            out += math.log10(self.weight(state, w))
            state = (*state, w)[-(self.order - 1):]
            while len(state) > 1 and state not in self.contexts[len(state)]:
                state = state[1:]
        return out


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("limits", [{}, {"batch_tokens": 3000, "bucket_entries": 2000}])
def test_scores_equal_a_plain_automaton(spark, order, limits):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()] + [(90001, None), (90002, ""), (90003, "A a"), (90003, "A a")]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    model = PlainModel([tokens(t) for d, t in rows if not held(d)], order)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train_", F.lit("clash")).repartition(3)
    got = backoff_lm.score(frame, order=order, **limits).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(model.words[(w,)] > 0 for w in t), model.n, held(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10(model.weight((), w)) for w in t), abs=1e-6)
        assert r.score == pytest.approx(model.score(t), abs=1e-6)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_of_a_context_sum_to_one():
    counts, share = np.array([4, 2, 2]), np.full(64, 0.4)
    root = (counts + 0.5) / (8 + 0.5 * 4)  # the rest, 0.5 / 10, is for unknown words
    seen = np.array([3, 0, 1])
    total = sum((1 - 0.4) * s / 4 + 0.4 * r for s, r in zip(seen, root)) + 0.4 * 0.05
    assert total == pytest.approx(1.0) and len(share) == backoff_lm.N_CLASSES


def test_model_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert backoff_lm.score(empty).count() == 0
    only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    r = backoff_lm.score(spark.createDataFrame([(only, "x y")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.held_out) == (0, 0, True) and r.score == pytest.approx(3 * math.log10(0.5 / 0.5))


def test_packing():
    values = np.array([0, 5, 5, 2**63], np.uint64)
    assert (text_kernels.unpack(text_kernels.pack(values, True), np.uint64, True) == values).all()
    assert len(text_kernels.unpack(text_kernels.pack(values[:0]), np.uint64)) == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    raw = boosting.BoostedTrees().fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.95
    curve = boosting.Isotonic(raw, y[1500:])
    assert (np.diff(curve(np.sort(raw))) >= 0).all() and 0 <= curve(raw).min() <= curve(raw).max() <= 1


def test_identity_of_the_pairs():
    fm = quality_fm.FactorisationMachine(bits=4, rank=3)
    feature, value = np.array([1, 5, 9]), np.array([0.5, 2.0, 1.0], np.float32)
    fm.w[:] = 0.1
    want = sum(fm.w[f] * x for f, x in zip(feature, value)) + sum(float(fm.v[a] @ fm.v[b]) * value[i] * value[j] for i, a in enumerate(feature) for j, b in enumerate(feature) if i < j)
    assert fm.margins(feature, value, np.array([0, 3]))[0][0] == pytest.approx(want, abs=1e-5)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")


@pytest.mark.parametrize("module, target, threshold, least", [(toxicity, "toxic", 0.3, 0.95), (quality_fm, "quality", 0.7, 0.97)])
def test_held_out_accuracy(spark, tables, module, target, threshold, least):
    docs, labels = tables
    scored = toxicity.score(docs, module.fit(docs, labels)).join(labels, "doc_id").where(labelled.fold("doc_id", 4) == 2)
    right = scored.agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col(target)).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert right[3] > 500 and right[0] > least and 0 <= right[1] <= right[2] <= 1


@pytest.mark.parametrize("module", [toxicity, quality_fm])
def test_odd_rows_and_missing_labels(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 5000), (3, "x"), (None, "You idiot")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, module.fit(docs, none)).collect()
    assert len(got) == 5 and all(r.score == 0 for r in got)
    assert toxicity.score(docs.limit(0), module.fit(docs, none)).count() == 0


def test_samples_are_bounded_and_disjoint(spark, tables):
    docs, labels = tables
    a = labelled.training_sample(docs, labels, "toxic", 50, per_class=True, part=0, parts=2)
    assert sorted(r["count"] for r in a.groupBy("label").count().collect()) == [50, 50]
    assert labelled.training_sample(docs, labels, "toxic", 70).count() == 70


def _hash(word):
    data = np.frombuffer(word, np.uint8)
    return int(text_kernels.hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def plain_features(text, weights):
    """The features by their definitions, word by word; ``weights`` is the word list."""
    data = (text or "").encode()
    lower = bytes(b | 32 if 65 <= b <= 90 else b for b in data)
    found = [m.span() for m in re.finditer(rb"[A-Za-z\x80-\xff]+", data)]
    words = [lower[a:b] for a, b in found]
    insults, you = ({w.encode() for w in words_} for words_ in (toxicity.INSULTS, toxicity.YOU))
    per = max(len(words), 1)
    weight = [weights.get(w, 0.0) for w in words]
    insult = [w in insults for w in words]
    mark = [w in you for w in words]
    hits = [k for k, w in enumerate(words) if weight[k] > 0 or insult[k]]
    hard = [k for k, w in enumerate(words) if weight[k] > 3.5 or insult[k]]
    near = sum(any(mark[j] and abs(j - k) <= 4 for j in range(len(words))) for k in hits)
    close = sum(any(j != k and abs(j - k) <= 12 for j in hard) for k in hard)
    letters, bytes_ = max(sum(b - a for a, b in found), 1), max(len(data), 1)
    shouted = sum(b - a > 1 and all(65 <= c <= 90 for c in data[a:b]) for a, b in found)
    marks = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    repeated = sum(lower[k] == lower[k - 1] == lower[k - 2] and is_letter(data[k]) for k in range(2, len(data)))
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    mixed = sum(b - a > 2 and any(c in marks or 48 <= c <= 57 for c in data[a + 1:b - 1]) for a, b in spans)
    table = bytes.maketrans(b"013457@$", b"oleastas")
    hidden = sum((p := lower[a:b].translate(table)) != lower[a:b] and (p in insults or p in weights) for a, b in spans)
    n_listed, n_strong, n_insult = sum(w > 0 for w in weight), sum(w > 3.5 for w in weight), sum(insult)
    return [
        n_listed, n_listed / per, n_strong, n_strong / per, sum(weight), sum(weight) / per, n_insult, n_insult / per, sum(mark) / per, near, near / per, close,
        sum(65 <= c <= 90 for c in data) / letters, shouted / per, sum(c in marks for c in data) / bytes_, data.count(b"!") / bytes_, data.count(b"?") / bytes_, repeated / bytes_,
        mixed / max(len(spans), 1), hidden, math.log1p(len(words)),
    ]


def test_features_by_their_definitions():
    weights = {b"bad": 2.5, b"vile": 4.0, "r\u00e4udig".encode(): 5.0}
    lexicon = toxicity.Lexicon.of([(0, _hash(w), o) for w, o in weights.items()])
    texts = ["You are a BAD, bad idiot! and a b4d 1diot", None, "", "vile " + "x " * 14 + "vile", "vile " + "x " * 10 + "vile du", "r\u00e4udig?? soooo @#1a y0u", "idiot", "scum\nyou VILE", "plain words only here"]
    got = toxicity.features(pa.array(texts, pa.string()), lexicon)
    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_features(t, weights)), t


def plain_tree(tree, depth, row):
    feature, threshold, leaf = tree
    slot = 0
    for _ in range(depth):
        slot = 2 * slot + (2 if row[feature[slot]] > threshold[slot] else 1)
    return leaf[slot - (2**depth - 1)]


def test_a_stump_is_the_best_split():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    made = boosting.BoostedTrees(n_trees=1, depth=1).fit(x, y)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))
    part = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1.0)
    best = max((part(x[:, f] <= c) + part(x[:, f] > c), -f, -c) for f in range(3) for c in range(8) if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 3)
    feature, threshold, leaf = made.trees[0]
    at = x[:, feature[0]] > threshold[0]
    assert part(at) + part(~at) == pytest.approx(best[0])
    assert leaf.tolist() == pytest.approx([-0.15 * g[~at].sum() / (h[~at].sum() + 1), -0.15 * g[at].sum() / (h[at].sum() + 1)])


def test_toxicity_query_equals_plain_scoring(spark):
    folder = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    tables = {k: dict(zip(t.tolist(), o.tolist(), strict=True)) for k, (t, o) in model.lexicon.tables.items()}

    class Weights(dict):
        """The list by stems: a word's largest log odds."""

        def get(self, word, default):
            own = [table.get(_hash(word), 0) if k == 0 else table.get(int(text_kernels.mix(np.array([_hash(word[:k])], np.uint64) + np.uint64(k))[0]), 0) for k, table in tables.items() if k == 0 or len(word) > k]
            return max([default, *own])

        def __contains__(self, word):
            return _hash(word) in tables[0]

    got = {r.doc_id: r for r in queries.op4_toxicity(spark, folder).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in rows[::25]:
        x = plain_features(r.text, Weights())
        raw = model.scorer.trees.start + sum(plain_tree(t, model.scorer.trees.depth, x) for t in model.scorer.trees.trees)
        want = min(1, max(0, float(model.scorer.curve(np.array([raw]))[0])))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-6)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_quality_query_equals_plain_scoring(spark):
    folder = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_fm.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op5_quality_fm(spark, folder).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in rows[::25]:
        found = {_hash(w.encode()) >> (64 - model.bits) for w in tokens(r.text)[:-1]}
        stats = quality_fm.statistics(pa.array([r.text], pa.string()), pa.array([r.n_chars], pa.int64()))[0]
        x = {slot: 1 / math.sqrt(len(found)) for slot in found}
        x |= {(1 << model.bits) + k * quality_fm.N_BINS + sum(e < v for e in model.edges[k]): 0.5 for k, v in enumerate(stats)}
        at = sorted(x)
        v = np.array([model.v[k] * x[k] for k in at], np.float64)
        pairs = sum(float(v[i] @ v[i + 1:].sum(0)) for i in range(len(at)))
        raw = model.bias + sum(float(model.w[k]) * x[k] for k in at) + pairs
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-3)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    whole = labelled.training_sample(docs, labels, "quality", 1000).count()
    assert whole > 20 and labelled.training_sample(docs, labels, "quality", 1000, most_bytes=1050).count() == 10
