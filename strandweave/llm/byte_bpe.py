"""Byte-level BPE encoding and decoding.

Pre-tokenisation works without a regular expression.  Every code point gets a
class (letter, number, other, white space, ...; one step of lookahead is
folded into the class), each class is a transition function on a small set of
states, and functions compose associatively: blocks of the class array are
reduced to one composed function each, the blocks' functions are scanned, and
each block is then replayed from its known entry state.  The slices between
the boundaries go through a bounded cache; the misses of a block are merged
together, one lowest-ranked pair per slice and round, on flat arrays.

The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  The rank file's path is a parameter.

Defined results: null and empty texts have no tokens and decode to no bytes;
repeated rows are encoded one by one; extra columns are ignored; an empty
table gives an empty result; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk

# classes of code points, with their lookahead
LETTER, NUMBER, OTHER, SPACE_RUN, BLANK_LAST, SPACE_LAST, SHORT_MARK, LONG_MARK = range(8)
N_CLASSES = 8
# states: what is open before the next code point
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
N_STATES = 8
#: Bytes of slices and their ids that a worker keeps, with an entry's overhead.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 180
#: Text bytes that are encoded at once: the slices of a block are Python objects, many times its size.
BLOCK_BYTES = 1 << 19
LONG_PIECE = 200
NO_RANK = np.int32(2**31 - 1)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins at this code point."""
    if kind == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if kind in (OTHER, SHORT_MARK, LONG_MARK):
        if state in (IN_OTHER, AFTER_BLANK):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT_MARK: ONE_MORE, LONG_MARK: TWO_MORE}[kind], True
    if kind == SPACE_RUN:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if kind == BLANK_LAST else FRESH), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transition table, begin table, the closure of the classes' functions under composition: (element after class, product of elements, element -> state from FRESH).

    Classes from N_CLASSES on open a text: they act as from FRESH in any state.
    """
    step = [[_step(FRESH if k >= N_CLASSES else s, k % N_CLASSES) for k in range(2 * N_CLASSES)] for s in range(N_STATES)]
    move = np.array([[n for n, _ in row] for row in step], np.uint8)
    begin = np.array([[b or k >= N_CLASSES for k, (_, b) in enumerate(row)] for row in step])
    elements = [tuple(range(N_STATES))]
    number = {elements[0]: 0}
    after: list[list[int]] = []
    for f in elements:  # grows while it is walked
        row = []
        for k in range(2 * N_CLASSES):
            g = tuple(int(move[s, k]) for s in f)
            if g not in number:
                number[g] = len(elements)
                elements.append(g)
            row.append(number[g])
        after.append(row)
    product = np.array([[number[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    return move, begin, np.array(after, np.uint16), product, np.array([f[FRESH] for f in elements], np.uint8)


def boundary_scan(kinds: np.ndarray, width: int = 256) -> np.ndarray:
    """True where a slice begins, for classes whose text starts carry + N_CLASSES."""
    if not len(kinds):
        return np.zeros(0, bool)
    move, begin, after, product, from_fresh = _monoid()
    classes = move.shape[1]
    rows = -(-len(kinds) // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat_after, flat_move, flat_begin = after.ravel(), move.ravel(), begin.ravel()
    total = np.zeros(rows, np.uint16)  # each block's composed function
    for k in range(width):
        total = flat_after[total.astype(np.intp) * classes + columns[k]]
    shift = 1
    while shift < rows:  # inclusive scan of the blocks' functions
        total[shift:] = product[total[:-shift], total[shift:]]
        shift *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = from_fresh[total[:-1]]
    out = np.empty((width, rows), bool)
    for k in range(width):
        at = state.astype(np.intp) * classes + columns[k]
        out[k] = flat_begin[at]
        state = flat_move[at]
    return np.ascontiguousarray(out.T).ravel()[:len(kinds)]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class by code point, without lookahead."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    # Unicode White_Space (fixed values)
    for first, last in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[first:last + 1] = SPACE_RUN
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and values of the code points of a UTF-8 buffer."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    value = lead.astype(np.int32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        tail = np.concatenate([data, np.zeros(3, np.uint8)]) & 0x3F
        p, b = at[wide], lead[wide].astype(np.int32)
        t = [tail[p + k].astype(np.int32) for k in (1, 2, 3)]
        value[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | t[0], np.where(b < 0xF0, (b & 0x0F) << 12 | t[0] << 6 | t[1], (b & 7) << 18 | t[0] << 12 | t[1] << 6 | t[2]))
    return at, value


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pre-token slices of the concatenated texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, value = code_points(data)
    kinds = _class_table()[value]
    opens = np.searchsorted(at, np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]))
    n = len(at)
    last = np.zeros(n + 1, bool)  # code points that close their text
    last[opens[1:] - 1] = True
    last[n - 1] = True
    space = kinds == SPACE_RUN
    before_ink = np.zeros(n, bool)
    before_ink[:-1] = ~space[1:]
    before_ink &= ~last[:n]
    kinds[space & before_ink] = SPACE_LAST
    kinds[(value == 32) & before_ink] = BLANK_LAST
    marks = np.flatnonzero(value == 39)
    if len(marks):
        beyond = np.concatenate([value, np.zeros(2, np.int32)])
        one = np.where(last[marks], 0, beyond[marks + 1])
        two = np.where(last[marks] | last[np.minimum(marks + 1, n)], 0, beyond[marks + 2])
        kinds[marks[np.isin(one, [115, 116, 109, 100])]] = SHORT_MARK  # s t m d
        kinds[marks[(one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)]] = LONG_MARK  # re ve ll
    kinds[opens] += N_CLASSES
    return at[boundary_scan(kinds)]


class Codec:
    """Encoder and decoder for one rank file; one per Python worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.token_offsets[1:])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.diff(self.token_offsets)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        joined = [(get(t[:k]) << 20 | get(t[k:]), r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        joined.sort()
        self.pair_keys = np.array([k for k, _ in joined] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in joined] + [NO_RANK], np.int32)
        self.cache: dict[bytes, bytes] = {}
        self.cached = 0
        self.pairs: dict[int, int] | None = None

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def _merge_long(self, piece: bytes) -> bytes:
        """One long slice with a heap of pairs."""
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        if self.pairs is None:
            self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
        pairs = self.pairs
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pairs.get(rank << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0:
                h = before[i]
                if (r := pairs.get(ids[h] << 20 | rank)) is not None:
                    heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x, there in zip(ids, alive, strict=True) if there], "<u4").tobytes()

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each slice; all slices are merged side by side."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        rank = np.full(len(symbols), NO_RANK, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self._pair_rank(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK
        done_of, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            count = np.diff(np.concatenate([starts, [len(of)]]))
            open_ = np.repeat(lowest != NO_RANK, count)
            if not open_.all():
                done_of.append(of[~open_])
                done_symbols.append(symbols[~open_])
                symbols, of, rank = symbols[open_], of[open_], rank[open_]
                count, lowest = count[lowest != NO_RANK], lowest[lowest != NO_RANK]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, count))
            hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]  # the leftmost of each slice
            symbols[hit] = rank[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            symbols, of = symbols[keep], of[keep]
            rank[hit] = rank[hit + 1]
            rank = rank[keep]
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(symbols))]
                left = left[of[left] == of[left + 1]]
                rank[left] = self._pair_rank(symbols[left], symbols[left + 1])
            ended = at[np.concatenate([of[at[:-1]] != of[np.minimum(at[:-1] + 1, len(of) - 1)], [at[-1] + 1 >= len(of) or of[at[-1]] != of[at[-1] + 1]]])]
            rank[ended] = NO_RANK
        if done_of:
            of, symbols = np.concatenate(done_of), np.concatenate(done_symbols)
            order = np.argsort(of, kind="stable")
            packed = symbols[order].astype("<u4").tobytes()
            at = np.searchsorted(of[order], np.arange(len(pieces) + 1)).tolist()
            out = [packed[4 * a:4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def _learn(self, missed: set[bytes], known: dict[bytes, bytes]) -> None:
        pending = []
        for p in missed:
            whole = self.ranks.get(p)
            if whole is not None:
                known[p] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                known[p] = self._merge_long(p)
            else:
                pending.append(p)
        if pending:
            known.update(zip(pending, self._merge(pending), strict=True))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte position of each token in the block, n + 1 token offsets by text, n + 1 byte offsets by text)."""
        data, offsets = tk.utf8(texts)
        starts = slice_starts(data, offsets)
        buffer, edges = data.tobytes(), [*starts.tolist(), len(data)]
        pieces = [buffer[a:b] for a, b in zip(edges, edges[1:])]
        known = self.cache
        packed = list(map(known.get, pieces))
        if None in packed:
            missed = {p for p, ids in zip(pieces, packed, strict=True) if ids is None}
            self._learn(missed, known)
            self.cached += sum(len(p) + len(known[p]) + ENTRY_BYTES for p in missed)
            packed = list(map(known.__getitem__, pieces))
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        positions = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=positions[1:])
        return ids, positions[:-1], np.searchsorted(positions[:-1], offsets) if len(ids) else np.zeros(len(offsets), np.int64), offsets

    def decode_block(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        source = np.repeat(self.token_offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.token_bytes[source].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["key"].dataType.simpleString()


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>, token_bytes array<int>): token_bytes has each token's byte offset in its text."""
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for block in tk.blocks(batches, size=BLOCK_BYTES):
            ids, at, tokens, offsets = own.encode_block(block.column(1))
            inside = at - offsets[tk.value_index(tokens)]
            bounds = pa.array(tokens, pa.int32())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(tokens), pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(inside, pa.int32()))], names=["key", "n_tokens", "ids", "token_bytes"])

    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids array<int>, token_bytes array<int>").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids decode to empty text."""
    rows = encoded.select(F.col(id_col).alias("key"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            texts = [own.decode_block(np.asarray(ids.values, np.int64)).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so ids do not travel.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the bytes that the ids decode to.
    """
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for block in tk.blocks(batches, size=BLOCK_BYTES):
            ids, _, tokens, _ = own.encode_block(block.column(1))
            packed, edges = ids.astype("<u4").tobytes(), tokens.tolist()
            decoded = own.decode_block(ids)
            ends = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(own.lengths[ids], out=ends[1:])
            cuts = ends[tokens].tolist()
            a = [hashlib.sha256(packed[4 * x:4 * y]).hexdigest() for x, y in zip(edges, edges[1:])]
            b = [hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(tokens), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)
