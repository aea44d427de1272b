"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

A word list is learned from labelled documents, words and word stems (leading
bytes) with their log odds, counted on executors; a second, disjoint sample
gives the trees their rows.  Both samples are bounded by parameters.  Features are densities of list
words, their nearness to second-person words, capitals, punctuation and signs
of obfuscation.  Scoring is one narrow pass over whole texts.

Defined results: null and empty texts get the score of a text without words;
repeated rows are scored one by one; without labels of both classes every
score is the labels' smoothed mean (0 without labels); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text_kernels as tk
from .boosting import Calibrated
from .labelled import training_sample

LEXICON_ROWS = 2_000  # of each class
TREE_ROWS = 12_000
LEXICON_TERMS = 4_000
STEMS = (4, 5, 6, 7, 8)
# Common insults and second-person words of four languages (fixed values)
INSULTS = "idiot idiots moron morons stupid loser losers scum pathetic worthless disgusting trash clown dumb fool jerk vermin dumm trottel idiotin abschaum versager widerlich arschloch imbécile idiote crétin débile ordure nul salaud imbécil idiota estúpido estúpida basura payaso asqueroso patético".split()
YOU = "you your yours yourself youre du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[np.frombuffer(b"013457@$", np.uint8)] = np.frombuffer(b"oleasta" + b"s", np.uint8)


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = tk.utf8(pa.array(words, pa.string()))
    return np.unique(tk.hash_spans(data, offsets[:-1], offsets[1:]))


def _in(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(words long enough, hash of their first ``length`` bytes); length 0: the whole words."""
    if not length:
        return np.arange(len(starts)), tk.hash_spans(data, starts, ends)
    at = np.flatnonzero(ends - starts > length)
    return at, tk.mix(tk.hash_spans(data, starts[at], starts[at] + length) + np.uint64(length))


def _near(hit: np.ndarray, mark: np.ndarray, of: np.ndarray, reach: int) -> np.ndarray:
    """Hits with a mark at most ``reach`` words away in the same text."""
    at, to = np.flatnonzero(mark), np.flatnonzero(hit)
    out = np.zeros(len(hit), bool)
    if len(at) and len(to):
        right = np.searchsorted(at, to)
        for k in (right - 1, right):
            ok = (k >= 0) & (k < len(at))
            j = at[np.clip(k, 0, len(at) - 1)]
            out[to[ok & (np.abs(j - to) <= reach) & (of[j] == of[to])]] = True
    return out


def _near_another(hit: np.ndarray, of: np.ndarray, reach: int) -> np.ndarray:
    """Hits with another hit at most ``reach`` words away in the same text."""
    to = np.flatnonzero(hit)
    close = (np.diff(to) <= reach) & (of[to[1:]] == of[to[:-1]])
    out = np.zeros(len(hit), bool)
    out[to[1:][close]] = True
    out[to[:-1][close]] = True
    return out


class Lexicon:
    """Sorted hashes with their log odds, by stem length (0: whole words)."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        self.insults, self.you = _hashes(INSULTS), _hashes(YOU)

    @staticmethod
    def of(entries: list[tuple[int, int, float]]) -> "Lexicon":
        """entries: (stem length, term hash, log odds)."""
        tables = {}
        for length in (0, *STEMS):
            own = sorted((term % (1 << 64), odds) for k, term, odds in entries if k == length)
            tables[length] = np.array([t for t, _ in own], np.uint64), np.array([o for _, o in own], np.float64)
        return Lexicon(tables)

    def weights(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The largest log odds of a list entry that each word matches, else 0."""
        out = np.zeros(len(starts))
        for length, (terms, odds) in self.tables.items():
            if len(terms):
                at, hashes = _terms(data, starts, ends, length)
                place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                own = np.where(terms[place] == hashes, odds[place], 0)
                out[at] = np.maximum(out[at], own)
        return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = tk.utf8(texts)
    lower = tk.lower_ascii(data)
    starts, ends, words = tk.spans(_LETTER[data], offsets)
    return data, offsets, lower, starts, ends, words


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    data, offsets, lower, starts, ends, words = _words(texts)
    n_words = np.diff(words)
    per = np.maximum(n_words, 1)
    of = tk.value_index(words)
    hashes = tk.hash_spans(lower, starts, ends)
    weight = lexicon.weights(lower, starts, ends)
    listed, strong = weight > 0, weight > 3.5
    insult, you = _in(hashes, lexicon.insults), _in(hashes, lexicon.you)
    near = _near(listed | insult, you, of, 4)
    close = _near_another(strong | insult, of, 12)
    length = np.diff(offsets)
    bytes_ = np.maximum(length, 1)
    upper = (data - np.uint8(65)) < 26
    letters = np.maximum(tk.sums_by_value(_LETTER[data], offsets), 1)
    capital = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=capital[1:])
    shouted = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 1)
    mark = _MARK[data]
    repeated = np.zeros(len(data), bool)
    repeated[2:] = (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2]) & _LETTER[data[2:]]
    # whole tokens: letters mixed with digits or symbols, and list words once they are written plainly
    flags = ~tk.space_flags(data)
    t_start, t_end, tokens = tk.spans(flags, offsets)
    plain = _PLAIN[lower]
    changed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(plain != lower, out=changed[1:])
    odd = np.flatnonzero(changed[t_end] > changed[t_start])
    hidden = np.zeros(len(t_start), bool)
    if len(odd):
        found = tk.hash_spans(plain, t_start[odd], t_end[odd])
        hidden[odd] = _in(found, lexicon.insults) | _in(found, lexicon.tables.get(0, (np.zeros(0, np.uint64),))[0])
    inner = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mark | ((data - np.uint8(48)) < 10), out=inner[1:])
    mixed = (inner[np.maximum(t_end - 1, t_start)] - inner[np.minimum(t_start + 1, t_end)] > 0) & (t_end - t_start > 2)
    summed = lambda v: tk.sums_by_value(v, words)
    total = np.zeros(len(weight) + 1)
    np.cumsum(weight, out=total[1:])
    mass = total[words[1:]] - total[words[:-1]]
    n_tokens = np.maximum(np.diff(tokens), 1)
    columns = [
        summed(listed), summed(listed) / per, summed(strong), summed(strong) / per, mass, mass / per, summed(insult), summed(insult) / per,
        summed(you) / per, summed(near), summed(near) / per, summed(close), tk.sums_by_value(upper, offsets) / letters, summed(shouted) / per,
        tk.sums_by_value(mark, offsets) / bytes_, tk.sums_by_value(data == 33, offsets) / bytes_, tk.sums_by_value(data == 63, offsets) / bytes_,
        tk.sums_by_value(repeated, offsets) / bytes_, tk.sums_by_value(mixed, tokens) / n_tokens, tk.sums_by_value(hidden, tokens), np.log1p(n_words),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def _learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms are counted by document on executors; only the strongest of each stem length come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            _, _, lower, starts, ends, words = _words(block.column(0))
            of, labels = tk.value_index(words), block.column(1).to_numpy()
            for length in (0, *STEMS):
                at, hashes = _terms(lower, starts, ends, length)
                pairs = np.unique(np.stack([hashes, of[at].astype(np.uint64)], 1), axis=0)
                terms, number = np.unique(pairs[:, 0], return_inverse=True)
                bad = np.bincount(number, labels[pairs[:, 1].astype(np.int64)], len(terms)).astype(np.int64)
                n = np.bincount(number, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), length), pa.int64()), pa.array(terms.view(np.int64)), pa.array(bad), pa.array(n - bad, pa.int64())], names=["length", "term", "bad", "good"])

    n_bad, n_all = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    found = sample.select("text", "label").mapInArrow(run, "length bigint, term bigint, bad bigint, good bigint").groupBy("length", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_all - n_bad + 1))
    strong = found.where(F.col("bad") >= max(3, n_bad // 200)).withColumn("odds", odds).where("odds > 2")
    ranked = strong.withColumn("nth", F.row_number().over(Window.partitionBy("length").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term")))
    return Lexicon.of([(r.length, r.term, r.odds) for r in ranked.where(F.col("nth") <= LEXICON_TERMS).select("length", "term", "odds").collect()])


class Model:
    def __init__(self, lexicon: Lexicon, scorer: Calibrated):
        self.lexicon, self.scorer = lexicon, scorer

    def score(self, texts: pa.Array, recorded: pa.Array) -> np.ndarray:
        return np.clip(self.scorer(features(texts, self.lexicon)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", lexicon_rows: int = LEXICON_ROWS, tree_rows: int = TREE_ROWS, **columns: str) -> Model:
    """Learn from at most ``lexicon_rows`` labelled rows of each class and ``tree_rows`` others, outside the held-out fold."""
    lexicon = _learn_lexicon(training_sample(docs, labels, target, lexicon_rows, per_class=True, part=0, parts=2, **columns))
    sample = training_sample(docs, labels, target, tree_rows, part=1, parts=2, **columns)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            x = features(block.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([block.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.mapInArrow(run, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.x, r.label))  # tasks end in any order
    x = np.array([r.x for r in rows]) if rows else np.zeros((0, 1))
    return Model(lexicon, Calibrated(x, np.array([r.label for r in rows], np.float64)))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """(id, score) of every row; the model has a size fixed by its parameters and is broadcast.

    ``chars_col``, a number of characters on record, is null where docs has no such column.
    """
    recorded = F.col(chars_col) if chars_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), recorded.try_cast("long").alias("recorded"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(shared.value.score(block.column(1), block.column(2)), pa.float64())], names=["key", "score"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", id_col)
