"""Quality classifier: a factorisation machine over hashed words and structure.

A text is a sparse vector: its distinct words, hashed, with values that give
the words one unit of length together, and one indicator for each bin of its
structure statistics (length in words and bytes, word length, symbols, capitals,
punctuation, digits, repeated words and lines) and of its metadata (characters
on record; a null has a bin of its own).  The score is
sigmoid(bias + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2)), linear in the
number of features.  The model has 2^bits rows, whatever the corpus.

Training takes a sample of labelled rows, bounded in rows and in bytes, by
AdaGrad on the driver.

Defined results: null and empty texts are vectors of structure bins only;
repeated rows are scored one by one; without labels of both classes every
score is the labels' smoothed mean; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text_kernels as tk
from .boosting import sigmoid
from .labelled import training_sample
from .quality_rules import measure_block
from .toxicity import score  # noqa: F401  the scoring pass is the same

TRAIN_ROWS = 8_000
TRAIN_BYTES = 64 << 20
BITS = 17
RANK = 8
N_BINS = 16
STATISTICS = 11
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!\"'(),-./:;?[]_{}", np.uint8)] = True


def statistics(texts: pa.Array, recorded: pa.Array) -> np.ndarray:
    """Structure and metadata of each text; -1 for a null on record."""
    data, offsets = tk.utf8(texts)
    m = measure_block(texts)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(np.diff(offsets), 1)
    columns = [
        np.log1p(m["n_words"]), np.log1p(np.diff(offsets)), m["word_chars"] / words, m["n_symbols"] / words, m["n_upper"] / np.maximum(m["n_letters"], 1), tk.sums_by_value(_MARK[data], offsets) / chars,
        tk.sums_by_value((data - np.uint8(48)) < 10, offsets) / chars, m["n_repeat_words"] / words, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_lines"] / words,
        np.log1p(np.maximum(recorded.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), 0)) - np.asarray(recorded.is_null()).astype(np.float64),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def word_slots(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of each text's distinct words, and their n + 1 offsets."""
    data, starts, ends, words = tk.words_of(texts)
    slot = (tk.hash_spans(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique(tk.value_index(words) << bits | slot)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(words)))


class FactorisationMachine:
    def __init__(self, bits: int = BITS, rank: int = RANK, seed: int = 7):
        self.bits, self.size = bits, (1 << bits) + STATISTICS * N_BINS
        self.bias, self.constant = 0.0, None
        self.edges = np.zeros((STATISTICS, N_BINS - 1))
        self.w = np.zeros(self.size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (self.size, rank)).astype(np.float32)

    def vectors(self, slots: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: feature, value, n + 1 offsets; every row ends with its structure bins."""
        n_words = np.diff(offsets)
        bins = np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, stats.T, strict=True)], 1) + (1 << self.bits) + np.arange(STATISTICS) * N_BINS
        out = np.concatenate([[0], np.cumsum(n_words + STATISTICS)])
        feature, value = np.empty(out[-1], np.int64), np.full(out[-1], 0.5, np.float32)
        tail = (out[1:, None] - STATISTICS + np.arange(STATISTICS)).ravel()
        feature[tail] = bins.ravel()
        head = np.ones(out[-1], bool)
        head[tail] = False
        feature[head], value[head] = slots, np.repeat(1 / np.sqrt(np.maximum(n_words, 1)), n_words)
        return feature, value, out

    def margins(self, feature: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and sum v x of each row; the pairs cost one pass by the sum-of-squares identity."""
        vx = self.v[feature] * value[:, None]
        starts = offsets[:-1]  # no row is empty
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        linear = np.add.reduceat(self.w[feature] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.08, penalty: float = 2e-5) -> "FactorisationMachine":
        """rows: (word slots, statistics) of each text."""
        if len(labels) < 10 or labels.min() == labels.max():
            self.constant = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.0
            return self
        stats = np.stack([s for _, s in rows])
        self.edges = np.quantile(stats, np.linspace(0, 1, N_BINS + 1)[1:-1], axis=0).T
        self.edges[-1, 0] = -0.5  # a null on record has the first bin to itself
        mean = labels.mean()
        self.bias = float(np.log(mean / (1 - mean)))
        seen_w, seen_v, seen_b = np.full(self.size, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        order = np.random.default_rng(1)
        for _ in range(epochs):
            shuffled = order.permutation(len(rows))
            for at in range(0, len(rows), batch):
                pick = shuffled[at:at + batch]
                slots = [rows[i][0] for i in pick]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in slots])])
                feature, value, bounds = self.vectors(np.concatenate(slots), offsets, stats[pick])
                raw, sums = self.margins(feature, value, bounds)
                slope = (sigmoid(raw) - labels[pick]).astype(np.float32)
                size = np.diff(bounds)
                each = np.repeat(slope, size) * value
                grad_v = each[:, None] * (np.repeat(sums, size, axis=0) - self.v[feature] * value[:, None])
                by = np.argsort(feature, kind="stable")
                own = feature[by]
                head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                own = own[head]
                gw = np.add.reduceat(each[by], head) / len(pick) + penalty * self.w[own]
                gv = np.add.reduceat(grad_v[by], head, axis=0) / len(pick) + penalty * self.v[own]
                seen_w[own] += gw * gw
                seen_v[own] += gv * gv
                self.w[own] -= rate * gw / np.sqrt(seen_w[own])
                self.v[own] -= 0.3 * rate * gv / np.sqrt(seen_v[own])
                gb = float(slope.mean())
                seen_b += gb * gb
                self.bias -= rate * gb / np.sqrt(seen_b)
        return self

    def score(self, texts: pa.Array, recorded: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        slots, offsets = word_slots(texts, self.bits)
        return sigmoid(self.margins(*self.vectors(slots, offsets, statistics(texts, recorded)))[0].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, **columns: str) -> FactorisationMachine:
    """Learn from at most ``train_rows`` labelled rows, of at most ``train_bytes``, outside the held-out fold."""
    sample = training_sample(docs, labels, target, train_rows, most_bytes=train_bytes, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            slots, offsets = word_slots(block.column(0))
            stats = statistics(block.column(0), block.column(2))
            cuts = offsets.tolist()
            packed = [slots[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([block.column(1), pa.array(packed, pa.binary()), pa.array(list(stats), pa.list_(pa.float64()))], names=["label", "slots", "stats"])

    found = sample.mapInArrow(run, "label int, slots binary, stats array<double>").collect()
    found.sort(key=lambda r: (r.stats, bytes(r.slots), r.label))  # tasks end in any order
    rows = [(np.frombuffer(r.slots, np.int32).astype(np.int64), np.array(r.stats)) for r in found]
    return FactorisationMachine().fit(rows, np.array([r.label for r in found], np.float64))
