"""Language-model scoring with a weighted backoff automaton.

The model interpolates n-grams up to ``order`` words (three) with shorter ones,

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | g) = (1 - l) c(g w) / c(g) + l p(w | g'),    l = l(length of g, size class of c(g)),

where g' is g without its first word, a size class is a power of two of the
context's count and l is the class's discounted share of distinct
continuations, d * types / tokens with d = n1 / (n1 + 2 n2): all counted over
the whole training part.  Contexts are words, the start of a text, and longer
n-grams that occur twice or more.

As an automaton every context is a state and every n-gram that was seen after a
state is an arc with log p(w | g).  A state's failure arc, of weight log l,
leads to the state of g', from a word to the root, whose arc for w has log p(w).
An arc leads to the longest state that ends what was read.  One left-to-right
traversal carries each text's state, follows failure arcs until a word's arc is
there, and adds up log-probabilities; the texts of a batch step side by side.

The model grows with the corpus and is never gathered in one place.  Texts are
encoded once into batches (a written table); level by level each batch sends
its distinct n-grams to hash ranges as packed arrays, one row per batch and
range, and counts come back where several batches have the n-gram.  An n-gram
whose context or end no other batch has is not sent.  In the end the batch
builds the part of the automaton that its texts can reach.

Words are split at 0x20 and 0x09-0x0D with A-Z lower-cased; every text ends
with one end token, which counts as a token.  Hashes have 64 bits.

Defined results: null and empty texts are one end token; repeated rows count
and are scored one by one; a null id is in the fold of the empty text; without
training rows N = V = 0 and scores follow the formulas (l = 1); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk
from .labelled import fold
from .shared import checkpoint, release, shared_folder

ORDER = 3
LEAST_STATE = 2
BATCH_TOKENS = 3_000_000
BUCKET_ENTRIES = 2_000_000
N_CLASSES = 64
CHUNK = 1 << 18
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LEFT = np.uint64(0xD1342543DE82EF95)
_ENDS = 128


def size_class(count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2(count))."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64) * (count > 0)


def pair_hashes(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(context * _LEFT) + word)


def encode_block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and tokens per text."""
    data, starts, ends, words = tk.words_of(texts)
    length = np.diff(words) + 1
    out = np.full(int(length.sum()), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(length) - 1] = False
    out[inside] = tk.hash_spans(data, starts, ends)
    return out, length


class Batch:
    """Texts as numbers of the batch's sorted distinct words."""

    def __init__(self, vocabulary: np.ndarray, stream: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.vocabulary, self.stream, self.lengths = vocabulary, stream, lengths
        self.token_train = np.repeat(train, lengths)
        self.first = np.cumsum(lengths) - lengths

    @staticmethod
    def of(row: dict) -> "Batch":
        return Batch(tk.unpack(row["vocabulary"], np.uint64, True), tk.unpack(row["stream"], np.int32), tk.unpack(row["lengths"], np.int32).astype(np.int64), tk.unpack(row["train"], np.uint8) != 0)

    def word_counts(self) -> np.ndarray:
        """Training count of each word in the batch."""
        return np.bincount(self.stream[self.token_train], minlength=len(self.vocabulary))


class Grams:
    """The batch's distinct n-grams of one length, ordered by hash.

    ids: each token's n-gram that ends there, -1 where its context is no state;
    source and suffix: the numbers, one length shorter, of its context and of
    the n-gram without its first word; own and total: training counts in the
    batch and in all; shared: whether another batch has it.
    """

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, own: np.ndarray, source: np.ndarray | None, suffix: np.ndarray | None, ends: np.ndarray):
        self.hashes, self.ids, self.own, self.source, self.suffix, self.ends = hashes, ids, own, source, suffix, ends
        self.total, self.shared = own.copy(), np.zeros(len(own), bool)

    @staticmethod
    def words(batch: Batch, values: np.ndarray, n_texts: int) -> "Grams":
        """Single words by what came back (total and whether shared), and the start after them."""
        hashes = np.append(batch.vocabulary, START)
        out = Grams(hashes, batch.stream, np.append(batch.word_counts(), n_texts), None, None, hashes == END)
        out.total, out.shared = np.append((values >> 1), n_texts), np.append(values & 1 != 0, True)
        return out

    def states(self, length: int) -> np.ndarray:
        """Which n-grams are contexts."""
        return ~self.ends & (self.total >= LEAST_STATE) if length > 1 else ~self.ends

    def longer(self, batch: Batch, length: int) -> "Grams":
        """The n-grams one word longer, whose contexts are states of this ``length``."""
        contexts = np.empty(len(batch.stream), np.int32)
        contexts[1:] = self.ids[:-1]
        contexts[batch.first] = len(self.hashes) - 1 if length == 1 else -1
        at = np.flatnonzero((contexts >= 0) & self.states(length)[contexts]).astype(np.int32)
        hashes = np.empty(len(at), np.uint64)
        for a in range(0, len(at), CHUNK):  # temporaries stay small
            part = at[a:a + CHUNK]
            hashes[a:a + CHUNK] = pair_hashes(self.hashes[contexts[part]], batch.vocabulary[batch.stream[part]])
        order = np.argsort(hashes).astype(np.int32)
        sorted_ = hashes[order]
        del hashes
        head = np.ones(len(order), bool)
        head[1:] = sorted_[1:] != sorted_[:-1]
        start = np.flatnonzero(head)
        distinct = sorted_[head]
        del sorted_
        at = at[order]
        own = np.add.reduceat(batch.token_train[at], start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
        ids = np.full(len(batch.stream), -1, np.int32)
        ids[at] = np.cumsum(head, dtype=np.int32) - 1
        token = at[start]
        return Grams(distinct, ids, own, contexts[token], self.ids[token], batch.vocabulary[batch.stream[token]] == END)

    def asked(self, lower: "Grams") -> np.ndarray:
        """Those that another batch may have: both ends of them are elsewhere too."""
        return np.flatnonzero(lower.shared[self.source] & lower.shared[self.suffix] & (lower.total[self.suffix] > 0))

    def receive(self, asked: np.ndarray, returned: list[tuple[int, bytes, bytes]], bits: int) -> None:
        hashes = self.hashes[asked]
        for bucket, places, totals in returned:
            base = int(np.searchsorted(hashes, np.uint64(bucket << (64 - bits)))) if bits else 0
            at = asked[base + tk.unpack(places, np.uint32, True).astype(np.int64)]
            self.total[at], self.shared[at] = tk.unpack(totals, np.uint64).astype(np.int64), True


class Automaton:
    """The part that a batch's texts can reach; weights are log10.  ``share`` is l by length of the context and size class."""

    def __init__(self, levels: list[Grams], norm: float, share: np.ndarray):
        self.levels = levels
        self.root = np.log10((levels[0].total[:-1] + 0.5) / norm)
        self.arcs, self.failure = [self.root], []
        for length, grams in enumerate(levels[1:], 1):
            lower = levels[length - 1]
            part = share[length - 1, size_class(lower.total)]
            self.failure.append(np.log10(part))
            seen = np.flatnonzero(grams.total > 0)
            context = grams.source[seen]
            weight = np.full(len(grams.total), -np.inf)
            below = self.arcs[-1][grams.suffix[seen]]
            # what the suffix itself can't do by an arc, it does by failure; a seen n-gram's suffix was seen
            weight[seen] = np.log10((1 - part[context]) * grams.total[seen] / lower.total[context] + part[context] * 10**below)
            self.arcs.append(weight)
        # the longest state at the end of an n-gram
        self.target = [(np.ones(len(self.root), np.int8), np.arange(len(self.root)))]
        for length, grams in enumerate(levels[1:], 2):
            reach, number = self.target[-1][0][grams.suffix], self.target[-1][1][grams.suffix]
            if length < len(levels):
                own = np.flatnonzero(grams.states(length))
                reach, number = reach.copy(), number.copy()
                reach[own], number[own] = length, own
            self.target.append((reach, number))

    def traverse(self, batch: Batch) -> np.ndarray:
        """log10 probability of each text."""
        levels = self.levels
        order = np.argsort(-batch.lengths, kind="stable")
        first, lengths = batch.first[order], batch.lengths[order]
        total = np.zeros(len(order))
        reach = np.ones(len(order), np.int8)  # length of the carried state, and its number
        state = np.full(len(order), len(levels[0].hashes) - 1)
        active = len(order)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while active and lengths[active - 1] <= step:
                active -= 1
            at = first[:active] + step
            open_ = np.arange(active)
            for length in range(len(levels) - 1, 0, -1):
                grams = levels[length]
                mine = open_[reach[open_] == length]
                if not len(mine):
                    continue
                arc = grams.ids[at[mine]]
                there = (arc >= 0) & (grams.source[arc] == state[mine]) & (grams.total[arc] > 0) if len(grams.total) else np.zeros(len(mine), bool)
                hit, arc = mine[there], arc[there]
                total[hit] += self.arcs[length][arc]
                reach[hit], state[hit] = self.target[length][0][arc], self.target[length][1][arc]
                reach[hit] += np.int8(len(levels))  # done with this word
                miss = mine[~there]
                total[miss] += self.failure[length - 1][state[miss]]
                if length > 1:
                    state[miss] = levels[length - 1].suffix[state[miss]]
                reach[miss] = length - 1
            rest = open_[reach[:active] == 0]
            word = batch.stream[at[rest]]
            total[rest] += self.root[word]
            reach[rest], state[rest] = 1, word
            done = open_[reach[:active] > len(levels)]
            reach[done] -= np.int8(len(levels))
        out = np.empty(len(order))
        out[order] = total
        return out


def _encode(docs: DataFrame, train: Column, id_col: str, text_col: str, batch_tokens: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), train.alias("train"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, number = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([h for h, _, _ in held])
            vocabulary, stream = np.unique(hashes, return_inverse=True)
            lengths = np.concatenate([n for _, n, _ in held])
            keys = pa.concat_arrays([b.column(0) for _, _, b in held])
            flags = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for _, _, b in held]).astype(np.uint8)
            row = [pa.array([number], pa.int64()), pa.array([len(stream)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            return pa.RecordBatch.from_arrays([*row, *(pa.array([v], pa.binary()) for v in (tk.pack(flags), tk.pack(lengths.astype(np.int32)), tk.pack(stream.astype(np.int32)), tk.pack(vocabulary, True)))], names=["batch", "n_tokens", "keys", "train", "lengths", "stream", "vocabulary"])

        for block in tk.blocks(batches):
            hashes, lengths = encode_block(block.column(1))
            held.append((hashes, lengths, block))
            tokens += len(hashes)
            if tokens >= batch_tokens:
                yield flush()
                held, tokens, number = [], 0, number + 1
        if held:
            yield flush()

    encoded = rows.mapInArrow(run, f"batch bigint, n_tokens bigint, keys array<{kind}>, train binary, lengths binary, stream binary, vocabulary binary")
    path = f"{shared_folder(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    encoded.write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _ranges(batch: int, hashes: np.ndarray, arrays: list[np.ndarray], bits: int) -> list[tuple]:
    """One row per hash range of a batch's sorted hashes: (bucket, batch, hashes, arrays...)."""
    cuts = [0, len(hashes)] if not bits else [0, *np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(hashes)]
    return [(k, batch, tk.pack(hashes[a:b], True), *(tk.pack(x[a:b]) for x in arrays)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = [pa.int64() if n in ("bucket", "batch") else pa.binary() for n in names]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _statistics_of(total: np.ndarray, classes: np.ndarray, sums: list[int]) -> np.ndarray:
    """(two sums, distinct n-grams by their context's size class, tokens by their own as states)."""
    seen, state = total > 0, (total >= LEAST_STATE) & (classes < _ENDS)
    types = np.bincount(classes[seen] & (_ENDS - 1), minlength=N_CLASSES)
    tokens = np.bincount(size_class(total[state]), total[state], N_CLASSES)
    return np.concatenate([sums, types, tokens]).astype(np.int64)


N_STATISTICS = 2 + 2 * N_CLASSES
SENT, BACK = "bucket bigint, batch bigint, hashes binary, counts binary, classes binary", "batch bigint, bucket bigint, places binary, totals binary"
SENT_NAMES, BACK_NAMES = ["bucket", "batch", "hashes", "counts", "classes"], ["batch", "bucket", "places", "totals"]


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of one hash range, back to the batches that share an n-gram, and the range's statistics as batch -1.

    Words (no classes) come back whole, longer n-grams where another batch has
    them; negative buckets hold the statistics of what batches didn't send.
    """
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        stats = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return _table([(-1, bucket, b"", stats.tobytes())], BACK_NAMES)
    batches = table.column("batch").to_pylist()
    parts = [tk.unpack(x, np.uint64, True) for x in table.column("hashes").to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(h) for h in parts])])
    hashes = np.concatenate(parts)
    del parts
    counts = np.concatenate([tk.unpack(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(hashes)
    own = hashes[order]
    head = np.concatenate([[True], own[1:] != own[:-1]])
    start = np.flatnonzero(head)
    total = np.add.reduceat(counts[order], start)
    several = np.diff(np.append(start, len(own))) > 1
    del own, counts
    number = np.cumsum(head) - 1
    each, shared = np.empty(len(hashes), np.int64), np.empty(len(hashes), bool)
    each[order], shared[order] = total[number], several[number]
    words = table.column("classes")[0].as_py() == b""
    rows = []
    for b, x, y in zip(batches, bounds[:-1].tolist(), bounds[1:].tolist()):
        if words:
            rows.append((b, bucket, b"", tk.pack((each[x:y] << 1 | shared[x:y]).astype(np.uint64))))
        else:
            at = np.flatnonzero(shared[x:y])
            rows.append((b, bucket, tk.pack(at.astype(np.uint32), True), tk.pack(each[x:y][at].astype(np.uint64))))
    distinct = order[start]
    if words:
        # tokens of words as contexts, whatever their count; an end is none
        state = hashes[distinct] != END
        stats = np.concatenate([[np.count_nonzero(total), total.sum()], np.zeros(N_CLASSES), np.bincount(size_class(total[state]), total[state], N_CLASSES)]).astype(np.int64)
    else:
        classes = np.concatenate([tk.unpack(x, np.uint8) for x in table.column("classes").to_pylist()])[distinct]
        stats = _statistics_of(total, classes, [np.count_nonzero(total == 1), np.count_nonzero(total == 2)])
    tk.trim()
    return _table([*rows, (-1, bucket, b"", stats.tobytes())], BACK_NAMES)


def _statistics(back: DataFrame) -> np.ndarray:
    """Sum of the ranges' statistics: a fixed number of integers per range, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_STATISTICS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.int64())], names=["k", "v"])

    found = back.where("batch = -1").select("totals").mapInArrow(run, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(N_STATISTICS, np.int64)
    for r in found:
        out[r.k] = r.v
    return out


def _first(table: pa.Table, *names: str) -> dict:
    return {n: table.column(n)[0].as_py() for n in names}


def _levels(batch: Batch, back: pa.Table, order: int, n_texts: int, bits: int) -> tuple[list[Grams], np.ndarray]:
    """The batch's n-grams up to ``order`` words with what came back, and those of the longest that it asks or asked for."""
    returned: dict[int, list] = {}
    for level, bucket, places, totals in zip(*(back.column(c).to_pylist() for c in ("level", "bucket", "places", "totals")), strict=True):
        returned.setdefault(level, []).append((bucket, places, totals))
    values = np.concatenate([tk.unpack(totals, np.uint64) for _, _, totals in sorted(returned[1])]).astype(np.int64)
    levels, asked = [Grams.words(batch, values, n_texts)], np.zeros(0, np.int64)
    for length in range(2, order + 1):
        lower = levels[-1]
        grams = lower.longer(batch, length - 1)
        asked = grams.asked(lower)
        grams.receive(asked, returned.get(length, []), bits)
        levels.append(grams)
    return levels, asked


def score(docs: DataFrame, n_folds: int = 5, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, batch_tokens: int = BATCH_TOKENS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from all rows but the held-out fold; scores are log10.
    """
    if order < 2:
        raise ValueError("the order must be at least 2")
    spark = docs.sparkSession
    held_out = fold(id_col, n_folds) == held_out_fold
    encoded = _encode(docs, ~held_out, id_col, text_col, batch_tokens)
    n_all = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    word_bits = max(0, n_all // 8 // bucket_entries).bit_length()
    bits = max(0, n_all // 2 // bucket_entries).bit_length()
    columns = ("n_tokens", "train", "lengths", "stream", "vocabulary")

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for row in held.to_pylist():
                batch = Batch.of(row)
                rows = _ranges(row["batch"], batch.vocabulary, [batch.word_counts().astype(np.uint32)], word_bits)
                yield from _table([(*r, b"") for r in rows], SENT_NAMES).to_batches()

    sent = encoded.select("batch", *columns).mapInArrow(send_words, SENT)
    words = checkpoint(sent.groupBy("bucket").applyInArrow(_add_up, BACK))
    del sent  # a frame that is held keeps its exchanges
    release(spark, 4 * n_all)
    stats = _statistics(words)
    n_distinct, n_train = int(stats[0]), int(stats[1])
    n_texts = _train_texts(encoded)
    tokens = stats[2 + N_CLASSES:].astype(np.float64)
    tokens[size_class(np.array([n_texts]))[0]] += n_texts
    norm = n_train + 0.5 * (n_distinct + 1)
    back = words.where("batch >= 0").withColumn("level", F.lit(1))
    share = np.ones((order - 1, N_CLASSES))

    def sender(length: int):
        def send(held: pa.Table, back: pa.Table) -> pa.Table:
            row = _first(held, "batch", *columns)
            levels, asked = _levels(Batch.of(row), back, length, n_texts, bits)
            lower, grams = levels[-2:]
            classes = (size_class(lower.total[grams.source]) + _ENDS * grams.ends).astype(np.uint8)
            rows = _ranges(row["batch"], grams.hashes[asked], [grams.own[asked].astype(np.uint32), classes[asked]], bits)
            alone = np.ones(len(grams.own), bool)
            alone[asked] = False
            own = grams.own[alone]
            kept = _statistics_of(own, classes[alone], [np.count_nonzero(own == 1), np.count_nonzero(own == 2)])
            tk.trim()
            return _table([*rows, (-1 - row["batch"] % (1 << bits), row["batch"], b"", kept.tobytes(), b"")], SENT_NAMES)

        return send

    for length in range(2, order + 1):
        sent = encoded.select("batch", *columns).groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(sender(length), SENT)
        grams = checkpoint(sent.groupBy("bucket").applyInArrow(_add_up, BACK))
        del sent
        release(spark, 4 * n_all)
        stats = _statistics(grams)
        discount = stats[0] / (stats[0] + 2 * stats[1]) if stats[0] else 0.75
        part = np.clip(discount * stats[2:2 + N_CLASSES] / np.maximum(tokens, 1), 1e-4, 1)
        part[tokens == 0] = 1
        part[0] = 1
        share[length - 2] = part
        tokens = stats[2 + N_CLASSES:].astype(np.float64)
        back = back.union(grams.where("batch >= 0").withColumn("level", F.lit(length)))

    def traverse(held: pa.Table, back: pa.Table) -> pa.Table:
        row = _first(held, "batch", *columns)
        batch = Batch.of(row)
        levels, _ = _levels(batch, back, order, n_texts, bits)
        automaton = Automaton(levels, norm, share)
        known = np.add.reduceat((levels[0].total > 0)[batch.stream].astype(np.int64), batch.first)
        train = tk.unpack(row["train"], np.uint8)
        base = np.add.reduceat(automaton.root[batch.stream], batch.first)
        scores = automaton.traverse(batch)
        tk.trim()
        return pa.table({
            "key": held.column("keys").combine_chunks().flatten(), "held_out": pa.array(train == 0), "n_tokens": pa.array(batch.lengths, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(train), n_train), pa.int64()), "base_score": pa.array(base), "score": pa.array(scores),
        })

    key = docs.schema[id_col].dataType.simpleString()
    scored = encoded.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(traverse, f"key {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("key", id_col)


def _train_texts(encoded: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(tk.unpack(x, np.uint8).sum()) for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return encoded.select("train").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
