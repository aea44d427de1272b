"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of bounded text and indexes every
shard's word sequence.  The alphabet is the benchmark's own: a word that no
phrase has can be in no occurrence, so it and the end of a document become
separators.  All phrases search the shard together, backwards; occurrences are
located by sampled suffix positions and merged into removal spans.

The phrases are broadcast in parts of about ``PART_BYTES`` of benchmark text,
dealt by their items' hashes; driver and workers hold one part at a time, as
arrays, and a benchmark beyond ``MAX_BYTES`` is searched in several passes whose
spans are merged.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, with A-Z
lower-cased.  A phrase is a window of ``window`` consecutive words of an item;
a shorter item that has words is one phrase.

Defined results: null or empty texts have no words and no hits; items without
words and items with a null id are ignored; ids may have any type that sorts; items that repeat an id are one
item; repeated documents are judged one by one; extra columns are ignored; an
empty benchmark hits nothing.  Texts are indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk
from .fm_index import FMIndex

SHARD_BYTES = 4 << 20
PART_BYTES = 16 << 20
MAX_BYTES = 256 << 20

#: Upper case to lower case, bytes outside words to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


_WORD = np.array([b != 32 for b in _FOLD])


class Phrases:
    """Distinct windows of benchmark items, as places in a sequence of the words of a vocabulary."""

    def __init__(self, items: pa.Array, texts: pa.Array, window: int):
        data, offsets = tk.utf8(texts)
        folded = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
        first, last, words = tk.spans(_WORD[data], offsets)
        _, at, number = np.unique(tk.hash_spans(folded, first, last), return_index=True, return_inverse=True)
        buffer = folded.tobytes()
        self.vocabulary = {buffer[a:b]: k for k, (a, b) in enumerate(zip(first[at].tolist(), last[at].tolist()), 1)}
        self.sequence = (number + 1).astype(np.int32)
        # a window at every word that has enough after it; a short item is one
        count = np.diff(words)
        n_windows = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(count), dtype=np.int32), n_windows)
        starts = np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + words[:-1][item]
        lengths = np.minimum(count, window)[item]
        hashes = np.full(len(starts), np.uint64(0))
        for size in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == size)
            hashes[own] = tk.mix(tk.ngram_hashes(tk.mix(number.astype(np.uint64)), size)[starts[own]] + np.uint64(size))
        order = np.lexsort((item, hashes))
        hashes, item = hashes[order], item[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
        order, hashes, self.items = order[new], hashes[new], item[new]
        head = np.ones(len(order), bool)
        head[1:] = hashes[1:] != hashes[:-1]
        self.starts, self.lengths = starts[order[head]].astype(np.int32), lengths[order[head]].astype(np.int32)
        self.item_offsets = np.append(np.flatnonzero(head), len(order))
        self.ids = items


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint ones, in order; touching ones merge."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[head], reach[np.append(head[1:], True)]


class Shard:
    """The index of one block of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: dict[bytes, int]):
        folded, edges = data.tobytes().translate(_FOLD), offsets.tolist()
        tokens = b" \0 ".join([folded[a:b] for a, b in zip(edges, edges[1:])] + [b""]).split()
        ids = np.fromiter(map(vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
        stops = np.flatnonzero(ids < 0)
        #: n + 1 places of the documents' words in the sequence; each document has one end mark.
        self.bounds = np.concatenate([[0], stops + 1])
        self.n_words = np.diff(self.bounds) - 1
        gap = ids <= 0
        ids[gap] = 0
        keep = ~gap
        keep[1:] |= ~gap[:-1]  # one separator after each run
        self.places = np.flatnonzero(keep)
        text = ids[self.places]
        self.index = FMIndex(text, len(vocabulary) + 1) if len(text) > 1 else None

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word's place in the sequence) of every occurrence."""
        if self.index is None or not len(phrases.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.index.search_spans(phrases.sequence, phrases.starts, phrases.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return phrase, self.places[self.index.locate(rows)]


def _char_spans(text: bytes, first: list[int], last: list[int]) -> tuple[list[int], list[int]]:
    """Characters that the word spans cover in a text."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8)
    starts, ends, _ = tk.spans(folded != 32, np.array([0, len(folded)]))
    chars = np.zeros(len(folded) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=chars[1:])
    return chars[starts[first]].tolist(), chars[ends[np.array(last) - 1]].tolist()


RESULT = "n_words bigint, n_hit bigint, items array<{item}>, spans array<struct<first_word:bigint,end_word:bigint,start_char:bigint,end_char:bigint>>"


def _search_block(block: pa.RecordBatch, parts: list, kind: pa.DataType) -> pa.RecordBatch:
    data, offsets = tk.utf8(block.column(1))
    n = len(offsets) - 1
    starts, ends = [], []
    found: dict[int, set] = {}
    n_words = np.zeros(n, np.int64)
    for part in parts:
        phrases: Phrases = part.value
        shard = Shard(data, offsets, {**phrases.vocabulary, b"\0": -1})
        n_words = shard.n_words
        phrase, at = shard.occurrences(phrases)
        starts.append(at)
        ends.append(at + phrases.lengths[phrase])
        of = np.searchsorted(shard.bounds, at, "right") - 1
        count = np.diff(phrases.item_offsets)[phrase]
        entry = np.repeat(phrases.item_offsets[phrase], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique(np.stack([np.repeat(of, count), phrases.items[entry]], 1), axis=0)
        for doc, item in zip(pairs[:, 0].tolist(), phrases.ids.take(pa.array(pairs[:, 1])).to_pylist(), strict=True):
            found.setdefault(doc, set()).add(item)
        bounds = shard.bounds
        if len(parts) > 1:
            part.__dict__.pop("_value", None)  # one part in memory at a time
    if not parts:
        bounds = np.zeros(n + 1, np.int64)
        n_words = np.array([len(words(t)) for t in block.column(1).to_pylist()], np.int64)
    start, end = _merge(np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*ends, np.zeros(0, np.int64)]))
    own = np.searchsorted(bounds, start, "right") - 1 if len(start) else np.zeros(0, np.int64)
    n_hit = np.bincount(own, end - start, minlength=n).astype(np.int64)
    items = pa.array([sorted(found.get(k, ())) for k in range(n)], pa.list_(kind))
    per = np.searchsorted(own, np.arange(n + 1))
    start_char, end_char = [], []
    for i in np.flatnonzero(np.diff(per)).tolist():
        a, b = per[i], per[i + 1]
        x, y = _char_spans(data[offsets[i]:offsets[i + 1]].tobytes(), (start[a:b] - bounds[i]).tolist(), (end[a:b] - bounds[i]).tolist())
        start_char += x
        end_char += y
    fields = [pa.array(v, pa.int64()) for v in (start - bounds[own], end - bounds[own], start_char, end_char)]
    spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays(fields, names=["first_word", "end_word", "start_char", "end_char"]))
    return pa.RecordBatch.from_arrays([block.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items, spans], names=["key", "n_words", "n_hit", "items", "spans"])


def _one_pass(rows: DataFrame, test: DataFrame, parts: range, n_parts: int, window: int) -> DataFrame:
    """Search some parts of the items, of which the driver holds one at a time: (key, RESULT)."""
    shared, kind = [], None
    for k in parts:
        table = test.where(F.pmod(F.xxhash64("item"), F.lit(n_parts)) == k).select("item", "text").toArrow().combine_chunks()
        kind = table.schema.field("item").type
        if table.num_rows:
            shared.append(rows.sparkSession.sparkContext.broadcast(Phrases(table.column("item").combine_chunks(), table.column("text").combine_chunks(), window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches, size=SHARD_BYTES):
            yield _search_block(block, shared, kind)

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {RESULT.format(item=test.schema['item'].dataType.simpleString())}")


def search(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every document.

    n_hit: words inside any occurrence of a phrase; items: ids of the items
    with an occurring phrase, in order; spans: the merged occurrences, as word
    numbers and as characters.
    """
    test = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-size // part_bytes))
    per_pass = max(1, max_bytes // part_bytes)
    passes = [range(a, min(a + per_pass, n_parts)) for a in range(0, n_parts, per_pass)]
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    if len(passes) == 1:
        return _one_pass(rows, test, passes[0], n_parts, window).withColumnRenamed("key", id_col)
    # Rows with equal keys and texts have equal results: search the distinct ones, then join back.
    rows = rows.withColumn("mark", F.sha2(F.coalesce("text", F.lit("")), 256))
    distinct = rows.dropDuplicates(["key", "mark"]).select(F.struct("key", "mark").alias("key"), "text")
    found = None
    for parts in passes:
        one = _one_pass(distinct, test, parts, n_parts, window)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    fold = F.aggregate("all", F.array().cast("array<struct<first_word:bigint,end_word:bigint,start_char:bigint,end_char:bigint>>"), lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end_word"] >= s["first_word"]), F.concat(
        F.slice(done, F.lit(1), F.size(done) - 1),
        F.array(F.struct(F.element_at(done, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(done, -1)["end_word"], s["end_word"]).alias("end_word"), F.element_at(done, -1)["start_char"].alias("start_char"), F.greatest(F.element_at(done, -1)["end_char"], s["end_char"]).alias("end_char"))),
    )).otherwise(F.concat(done, F.array(s))))
    merged = merged.withColumn("spans", fold).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"]))
    back = rows.select("key", "mark").alias("r").join(merged.alias("m"), F.expr("r.key <=> m.key.key AND r.mark = m.key.mark"))
    return back.select(F.col("r.key").alias(id_col), "m.n_words", "m.n_hit", "m.items", "m.spans")


def contaminated(least_share: int = 20):
    """A document is contaminated if a word is hit and the hit words are at least one in ``least_share``."""
    return (F.col("n_hit") > 0) & (F.lit(least_share) * F.col("n_hit") >= F.col("n_words"))


def digest_of_items():
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
