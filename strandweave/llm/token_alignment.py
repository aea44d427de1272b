"""Cross-tokenizer alignment: groups between shared byte cuts, links inside them, and how often ids are linked in the corpus.

1. *Runs.*  Where neither tokenizer has a token across the single space between
   two words, texts are cut there, else a run is a whole text.  Each distinct
   run is encoded and aligned once a task: packed bitsets mark the byte at which
   each token ends, their AND has the cuts that both share, and ranks by
   popcount tell how many tokens of each end there.  The tokens between two cuts
   are a group, and every token of one side is linked with every token of the
   other in its group.
2. *Units.*  A block of whole texts is one row: its distinct runs with their
   tokens and groups, its documents as sequences of runs, and the distinct id
   pairs that they link, each with the number of its documents.
3. *Counts.*  A unit's pairs are dealt out by hash, packed; a pair's rows are
   one for each unit at most, so no pair outweighs the rest.  A bucket adds up
   the documents and answers each unit in the order of its pairs.  The highest
   count of each id of the first tokenizer is a table as long as its vocabulary.
4. *Answers.*  Units meet the answers of their buckets; counts add up by runs
   and then by documents.  Nothing of the corpus' pairs is broadcast or gathered.

Groups of many tokens on both sides are expanded by distinct ids with their
multiplicities, so a long run without shared cuts costs its distinct pairs.

Defined results: null and empty texts have no tokens, nor have texts that one
of the tokenizers does not spell byte by byte (after the space before them);
they are rows with empty groups and zeros.  Repeated rows are documents of
their own, ids may be null; extra columns are ignored; an empty table gives an
empty result; texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk
from .shared import shared_folder, stored

UNIT_BYTES = 1 << 20
#: Characters of distinct words that a task remembers.
KEPT_CHARS = 2 << 20
#: New words that are encoded as one text.
WORDS = 512
#: Letters before this one are classified alike by all versions of Unicode.
LATIN = "\u0250"
#: New runs that are aligned at once.
LEARNT = 1 << 15
#: Pairs of units that a bucket adds up, about.
BUCKET_PAIRS = 1 << 20
#: Groups with more links are expanded by distinct ids.
PLAIN_LINKS = 1 << 10
_A = np.uint64(32)


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer: texts to ids of the space and the text, and the bytes of each id's token, one after another.

    by_words: no token holds the last byte of a word and the single space after it.
    quick: ids of the space and a text of Latin letters, by a faster way to the same.
    """

    encode: Callable[[list[str]], list[list[int]]]
    quick: Callable[[str], list[int]]
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    by_words: bool


def _vocabulary(encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes], by_words: bool, quick: Callable[[str], list[int]] | None = None) -> Vocabulary:
    lengths = np.array([len(t) for t in tokens], np.int64)
    return Vocabulary(encode, quick or (lambda text: encode([text])[0]), np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths, by_words)


def byte_level_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, others are counted on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary file of the tokenizers library; special tokens' strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    letters = byte_level_letters()
    tokens = [b""] * own.get_vocab_size()
    for token, k in own.get_vocab().items():
        tokens[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    call = getattr(own, "encode_batch_fast", own.encode_batch)
    rules = json.loads(own.to_str())
    split = rules.get("pre_tokenizer") or {}
    by_words = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    return _vocabulary(lambda texts: [e.ids for e in call([f" {t}" for t in texts], add_special_tokens=False)], tokens, by_words, _by_ranks(rules, own.get_vocab(), letters) if by_words else None)


def _by_ranks(rules: dict, vocabulary: dict[str, int], letters: dict[str, int]) -> Callable[[str], list[int]] | None:
    """Pair merging by ids as ranks, where the vocabulary's merges are in order of their results' ids."""
    import tiktoken

    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in rules["model"]["merges"]]
    made, single = set(merged), {bytes([b]) for b in range(256)}
    spelled = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if all(c in letters for c in token)}
    # what no merge makes, as special tokens, is in no plain text
    ranks = {token: k for token, k in spelled.items() if token in single or k in made}
    if rules["model"].get("ignore_merges") or merged != sorted(made) or not single <= set(ranks) or len(ranks) != len(single) + len(made) or max(ranks[x] for x in single) > min(merged, default=0):
        return None
    from public_tokenizers import PATTERN

    own = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: own.encode_ordinary(f" {text}")


def pieces(path: str) -> Vocabulary:
    """A model of the sentencepiece library, which puts a space before a text itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for k in range(own.get_piece_size()):
        piece = own.id_to_piece(k)
        tokens.append(bytes([int(piece[3:5], 16)]) if own.is_byte(k) else piece.replace("▁", " ").encode())
    by_words = not any(b" " in t.lstrip(b" ") for t in tokens)
    return _vocabulary(lambda texts: own.encode(texts, num_threads=1), tokens, by_words)


KINDS = {"byte_level": byte_level, "pieces": pieces}


@dataclass(frozen=True)
class Tokenizer:
    """Which vocabulary file, and of what kind; workers read it by that path."""

    kind: str
    path: str

    def load(self) -> Vocabulary:
        return _loaded(self)


@lru_cache(maxsize=2)
def _loaded(tokenizer: Tokenizer) -> Vocabulary:
    """Once in a worker, whose tasks follow each other."""
    return KINDS[tokenizer.kind](tokenizer.path)


#: Single spaces between letters that are certainly no white space and no marks on a space, by any definition.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
PLAIN = re.compile(r"[!-~\w](?:[^ ]*[!-~\w])?")


def _one_by_one(side: Vocabulary, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each run)."""
    found = side.encode(runs)
    size = np.array([len(x) for x in found], np.int64)
    return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size


def _at_once(side: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words that may stand anywhere, from texts of many; those that aren't spelled byte by byte one by one."""
    out = []
    for k in range(0, len(words), WORDS):
        some = words[k:k + WORDS]
        text = " ".join(some)
        ids = np.array(side.quick(text) if max(text) < LATIN else side.encode([text])[0], np.int32)
        ends = np.cumsum(side.lengths[ids])
        to = np.cumsum([len(w.encode()) + 1 for w in some])
        at = np.searchsorted(ends, to)
        fits = len(ends) and ends[-1] == to[-1] and (ends[at] == to).all()
        out.append((ids, np.diff(at, prepend=-1)) if fits else _one_by_one(side, some))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _slices(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the chosen ones, and their n + 1 offsets; ``ends`` are the offsets of all."""
    size = ends[which + 1] - ends[which]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(ends[which] - to[:-1], size) + np.arange(int(to[-1]))], to


def _bitset(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """A bit for each byte at which a token ends, in words of 64."""
    flags = np.zeros(-(-n_bytes // 64) * 64, np.uint8)
    flags[ends - 1] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _selected(words: np.ndarray) -> np.ndarray:
    """Positions of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set bits up to and with each position."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    mask = ~np.uint64(0) >> (63 - (at & 63)).astype(np.uint64)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte position after each shared cut, tokens of A and of B up to it), from where tokens end."""
    a, b = _bitset(a_ends, n_bytes), _bitset(b_ends, n_bytes)
    cuts = _selected(a & b)
    return cuts + 1, _rank(a, cuts), _rank(b, cuts)


def _links(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, links) of all groups; plain ones by occurrence, large ones by distinct ids."""
    a_from, b_from = np.append(0, a_to[:-1])[:len(a_to)], np.append(0, b_to[:-1])[:len(b_to)]
    n, k = a_to - a_from, b_to - b_from
    plain = np.flatnonzero(n * k <= PLAIN_LINKS)
    size = (n * k)[plain]
    of = np.repeat(plain, size)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    x, y = a[a_from[of] + nth // k[of]], b[b_from[of] + nth % k[of]]
    groups, pairs, times = [of], [(x.astype(np.uint64) << _A) | y.astype(np.uint64)], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(n * k > PLAIN_LINKS).tolist():
        x, s = np.unique(a[a_from[g]:a_to[g]], return_counts=True)
        y, t = np.unique(b[b_from[g]:b_to[g]], return_counts=True)
        pairs.append(((x.astype(np.uint64) << _A)[:, None] | y.astype(np.uint64)[None, :]).ravel())
        times.append(np.outer(s, t).ravel().astype(np.int64))
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


@dataclass
class Runs:
    """Distinct runs: ids of both sides, how many of them each group has, and whether both sides spell the run; offsets by run."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    n: np.ndarray
    k: np.ndarray
    g_at: np.ndarray
    spelled: np.ndarray

    @staticmethod
    def none() -> Runs:
        return Runs(*[np.zeros(n, kind) for n, kind in zip((0, 1, 0, 1, 0, 0, 1), (np.int32, np.int64, np.int32, np.int64, np.int32, np.int32, np.int64), strict=True)], np.zeros(0, bool))

    def plus(self, more: Runs) -> Runs:
        join = lambda x, y: np.concatenate([x, y])
        to = lambda x, y: np.concatenate([x, x[-1] + y[1:]])
        return Runs(join(self.a, more.a), to(self.a_at, more.a_at), join(self.b, more.b), to(self.b_at, more.b_at), join(self.n, more.n), join(self.k, more.k), to(self.g_at, more.g_at), join(self.spelled, more.spelled))

    def take(self, which: np.ndarray) -> Runs:
        a, a_at = _slices(self.a, self.a_at, which)
        b, b_at = _slices(self.b, self.b_at, which)
        n, g_at = _slices(self.n, self.g_at, which)
        k, _ = _slices(self.k, self.g_at, which)
        return Runs(a, a_at, b, b_at, n, k, g_at, self.spelled[which])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, id pair, links)."""
        group, pair, times = _links(self.a, self.b, np.cumsum(self.n, dtype=np.int64), np.cumsum(self.k, dtype=np.int64))
        return np.repeat(np.arange(len(self.spelled)), np.diff(self.g_at))[group], pair, times


def _aligned(runs: list[str], a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, one: Vocabulary, two: Vocabulary) -> Runs:
    """Runs from their ids; those that a side doesn't spell byte by byte have none."""
    text = [b" " + r.encode() for r in runs]
    data, edges = np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])])
    a_at, b_at = (np.concatenate([[0], np.cumsum(x)]) for x in (a_size, b_size))
    use = _spells(one, a, a_at, data, edges) & _spells(two, b, b_at, data, edges)
    a, a_at = _chosen(a, a_at, use)
    b, b_at = _chosen(b, b_at, use)
    if (one.lengths[a] == 0).any() or (two.lengths[b] == 0).any():
        raise ValueError("a token without bytes has no place in an alignment")
    edges = np.concatenate([[0], np.cumsum(np.where(use, np.diff(edges), 0))])
    after, a_to, b_to = shared_groups(np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b]), int(edges[-1]))
    # a run's end is a cut
    return Runs(a, a_at, b, b_at, np.diff(a_to, prepend=0).astype(np.int32), np.diff(b_to, prepend=0).astype(np.int32), np.searchsorted(after, edges, "right"), use)


class Encoder:
    """Texts as numbers of runs, which are encoded and aligned when they are new."""

    def __init__(self, one: Vocabulary, two: Vocabulary):
        self.sides, self.by_words = (one, two), one.by_words and two.by_words
        self._forget()

    def _forget(self) -> None:
        #: The numbers of words that may stand anywhere, and of other runs after a space.
        self.known: dict[str, int] = {}
        self.chars, self.runs = 0, Runs.none()

    def _learn(self, names: list[str]) -> None:
        # apart by letters: one other letter takes all words of its text the slower way
        latin, other, spaced = [], [], []
        for x in names:
            (spaced if x[0] == " " else latin if x.isascii() or max(x) < LATIN else other).append(x)
        for new, together in ((latin, True), (other, True), (spaced, False)):
            for k in range(0, len(new), LEARNT):
                some = new[k:k + LEARNT]
                runs = some if together else [x[1:] for x in some]
                found = [(_at_once if together else _one_by_one)(side, runs) for side in self.sides]
                self.runs = self.runs.plus(_aligned(runs, *found[0], *found[1], *self.sides))
                self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
                self.chars += sum(map(len, some))

    def _names(self, text: str) -> list[str]:
        if not self.by_words:
            return [f" {text}"]
        return [r if r in self.known or PLAIN.fullmatch(r) else f" {r}" for r in CUT.split(text)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' runs, and their n + 1 offsets; nulls, empty texts and those that are not spelled have none."""
        if self.chars > KEPT_CHARS:
            self._forget()
        numbers: list[list[int]] = []
        later: list[tuple[int, list[str]]] = []
        for text in texts:
            try:
                numbers.append([self.known[w] for w in text.split(" ")] if text else [])
            except KeyError:
                later.append((len(numbers), self._names(text)))
                numbers.append([])
        self._learn([x for x in dict.fromkeys(chain.from_iterable(names for _, names in later)) if x not in self.known])
        for i, names in later:
            numbers[i] = [self.known[x] for x in names]
        at = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
        number = np.fromiter(chain.from_iterable(numbers), np.int64, int(at[-1]))
        return _chosen(number, at, tk.sums_by_value(~self.runs.spelled[number], at) == 0)


def _chosen(values: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the texts in ``use``, and their offsets, the others' empty."""
    size = np.where(use, np.diff(offsets), 0)
    return values[np.repeat(use, np.diff(offsets))], np.concatenate([[0], np.cumsum(size)])


def _spells(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether each text's tokens, joined, are its bytes."""
    same = tk.sums_by_value(vocabulary.lengths[ids], offsets) == np.diff(edges)
    own, _ = _chosen(ids, offsets, same)
    size = vocabulary.lengths[own]
    spelled = vocabulary.data[np.repeat(vocabulary.starts[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    want, bounds = _chosen(data, edges, same)
    return same & (tk.sums_by_value(spelled != want, bounds) == 0)


def _bucket_order(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, ascending within; and the bucket of each pair in that order."""
    bucket = (tk.mix(pairs) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


#: What a unit's row holds, packed: per run, per group, per document.
_KINDS = {"a": np.uint32, "b": np.uint32, "n": np.uint32, "k": np.uint32, "a_size": np.uint32, "b_size": np.uint32, "g_size": np.uint32, "number": np.uint32, "size": np.uint32}


def align(docs: DataFrame, a: Tokenizer, b: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row.

    groups: ``a1,a2|b1;a3|b2,b3``, the ids of both sides in order, groups apart
    by semicolons.  A pair's count is the number of documents that hold it
    linked; n_best are the links whose count is the highest of their A id,
    count_sum the sum of all links' counts.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    shared_folder(docs.sparkSession)

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(a.load(), b.load())
        for block in tk.blocks(batches, size=UNIT_BYTES):
            number, at = encoder(block.column(1).to_pylist())
            known, number = np.unique(number, return_inverse=True)
            own = encoder.runs.take(known)
            run, pair, _ = own.links()
            pairs, place = np.unique(pair, return_inverse=True)
            # a document has a pair once, whatever runs hold it
            doc = np.repeat(np.arange(block.num_rows), np.diff(at))
            held = np.unique(doc * max(len(known), 1) + number)
            links, link_at = _slices(place, np.searchsorted(run, np.arange(len(known) + 1)), held % max(len(known), 1))
            once = np.unique(np.repeat(held // max(len(known), 1), np.diff(link_at)) * max(len(pairs), 1) + links)
            freq = np.bincount(once % max(len(pairs), 1), minlength=len(pairs)).astype(np.uint32)
            values = {"a": own.a, "b": own.b, "n": own.n, "k": own.k, "a_size": np.diff(own.a_at), "b_size": np.diff(own.b_at), "g_size": np.diff(own.g_at), "number": number, "size": np.diff(at)}
            keys = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(0))
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(pairs)], pa.int64()), pa.array([tk.pack(pairs, True)], pa.binary()), pa.array([tk.pack(freq)], pa.binary()), *[pa.array([tk.pack(values[c].astype(t))], pa.binary()) for c, t in _KINDS.items()]], names=["keys", "n_pairs", "pairs", "freq", *_KINDS])
        tk.trim()

    units = stored(rows.mapInArrow(units_of, f"keys array<{kind}>, n_pairs bigint, pairs binary, freq binary, {', '.join(f'{c} binary' for c in _KINDS)}").withColumn("unit", F.monotonically_increasing_id()))
    buckets = (units.agg(F.sum("n_pairs")).first()[0] or 0) // BUCKET_PAIRS + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, pairs, freq in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                pairs, freq = tk.unpack(pairs, np.uint64, True), tk.unpack(freq, np.uint32)
                order, bucket = _bucket_order(pairs, buckets)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)) if len(first) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), pa.array([unit] * len(cuts), pa.int64()), pa.array([tk.pack(pairs[order[x:y]], True) for x, y in cuts], pa.binary()), pa.array([tk.pack(freq[order[x:y]]) for x, y in cuts], pa.binary())], names=["bucket", "unit", "pairs", "freq"])

    def add(table: pa.Table) -> pa.Table:
        """Answers for the units, and the highest counts of A ids."""
        own = [tk.unpack(x, np.uint64, True) for x in table.column("pairs").to_pylist()]
        freq = np.concatenate([tk.unpack(x, np.uint32) for x in table.column("freq").to_pylist()])
        pairs, number = np.unique(np.concatenate(own), return_inverse=True)
        count = np.bincount(number, freq, minlength=len(pairs)).astype(np.int64)
        answers = np.split(count[number], np.cumsum([len(x) for x in own])[:-1])
        first = np.flatnonzero(np.diff(pairs >> _A, prepend=~np.uint64(0)))
        top = tk.pack((pairs[first] >> _A).astype(np.int64)), tk.pack(np.maximum.reduceat(count, first))
        n = table.num_rows
        tk.trim()
        return pa.table({"unit": pa.array([*table.column("unit").to_pylist(), None], pa.int64()), "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int64()), "counts": pa.array([*map(tk.pack, answers), None], pa.binary()), "a": pa.array([None] * n + [top[0]], pa.binary()), "highest": pa.array([None] * n + [top[1]], pa.binary())})

    answers = stored(units.select("unit", "pairs", "freq").mapInArrow(deal, "bucket bigint, unit bigint, pairs binary, freq binary").groupBy("bucket").applyInArrow(add, "unit bigint, bucket bigint, counts binary, a binary, highest binary"))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(tk.unpack(x, np.int64)), pa.array(tk.unpack(y, np.int64))], names=["a", "highest"])

    # one row for each id of A's vocabulary at most
    best = answers.where("unit IS NULL").select("a", "highest").mapInArrow(tops, "a bigint, highest bigint").groupBy("a").agg(F.max("highest").alias("highest")).toArrow().sort_by("a")
    best_a, highest = best.column("a").to_numpy(), best.column("highest").to_numpy()

    def finish(unit: pa.Table, answered: pa.Table) -> pa.Table:
        got = {c: tk.unpack(unit.column(c)[0].as_py(), t).astype(np.int64) for c, t in _KINDS.items()}
        to = lambda c: np.concatenate([[0], np.cumsum(got[c])])
        runs = Runs(got["a"], to("a_size"), got["b"], to("b_size"), got["n"], got["k"], to("g_size"), np.ones(len(got["a_size"]), bool))
        run, pair, times = runs.links()
        pairs, place = np.unique(pair, return_inverse=True)
        order, _ = _bucket_order(pairs, buckets)
        count = np.zeros(len(pairs), np.int64)
        if answered.num_rows:
            count[order] = np.concatenate([tk.unpack(x, np.int64) for x in answered.sort_by("bucket").column("counts").to_pylist()])
        best_ = count == highest[np.searchsorted(best_a, (pairs >> _A).astype(np.int64))] if len(pairs) else np.zeros(0, bool)
        at, number = to("size"), got["number"]
        link_at = np.searchsorted(run, np.arange(len(runs.spelled) + 1))
        summed = lambda values: tk.sums_by_value(values[number], at)
        by_run = lambda values: tk.sums_by_value(values, link_at)
        spelled = spelled_groups(runs)
        edges, numbers = at.tolist(), number.tolist()
        groups = [b";".join([spelled[i] for i in numbers[x:y]]) for x, y in zip(edges, edges[1:])]
        tk.trim()
        return pa.table({
            "key": unit.column("keys").chunk(0).flatten(), "n_a": summed(got["a_size"]), "n_b": summed(got["b_size"]), "n_groups": summed(got["g_size"]),
            "n_links": summed(by_run(times)), "n_best": summed(by_run(times * best_[place])), "count_sum": summed(by_run(times * count[place])), "groups": pa.array(groups, pa.binary()).cast(pa.string()),
        })

    asked = units.select("unit", "keys", *_KINDS).groupBy("unit")
    counted = answers.where("unit IS NOT NULL").select("unit", "bucket", "counts").groupBy("unit")
    done = asked.cogroup(counted).applyInArrow(finish, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
    return done.withColumnRenamed("key", id_col)


def spelled_groups(runs: Runs) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each run."""
    n_to, k_to = np.cumsum(runs.n), np.cumsum(runs.k)
    code = np.zeros(len(runs.a) + len(runs.b), np.int64)
    last = np.zeros(len(runs.a), np.int64), np.zeros(len(runs.b), np.int64)
    last[0][n_to - 1], last[1][k_to - 1] = 1, 1
    # a group's B tokens come after its A tokens
    code[np.arange(len(runs.a)) + np.repeat(k_to - runs.k, runs.n)] = 4 * runs.a + last[0]
    code[np.arange(len(runs.b)) + np.repeat(n_to, runs.k)] = 4 * runs.b + 2 + last[1]
    names = _names(int(max(runs.a.max(initial=0), runs.b.max(initial=0))))
    at, codes = (runs.a_at + runs.b_at).tolist(), code.tolist()
    return [b"".join([names[c] for c in codes[i:j]])[:-1] for i, j in zip(at, at[1:])]


_known: list[bytes] = []


def _names(most: int) -> list[bytes]:
    """Spellings of ids up to ``most``: in A within and at the end of a group, in B so."""
    for i in range(len(_known) // 4, most + 1):
        _known.extend(b"%d%s" % (i, end) for end in (b",", b"|", b",", b";"))
    return _known
