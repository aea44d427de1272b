"""SimHash near duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit for each bit of its shingles' 64-bit hashes,
set where over half of them have it.  Documents whose fingerprints differ in at
most ``most`` bits link.

1. *Fingerprints* are made per document in Arrow batches; equal ones are one
   node from there on, by partial aggregates.
2. *Parts.*  Bits are grouped into m parts, correlated bits together, by a
   64 x 64 table of joint counts.
3. *Thresholds.*  If thresholds t_1 .. t_m add up to most - m + 1, two
   fingerprints within ``most`` bits agree in some part i up to t_i bits (a
   threshold of -1 leaves a part out).  Each fingerprint allots its own, by
   dynamic programming over the candidates that it would meet: counts of the
   values of each part's leading bits, exact for these, even for the others.
   Parts in which a large family agrees are so left to others where that is
   cheaper.  m is the number with the smallest expected cost of probes and
   candidates on the whole table, so it falls as tables grow.
4. *Probe.*  A fingerprint stands once under its value of each part, and asks
   under all values within its thresholds.  Values under which many stand are
   dealt out in tiles of bounded blocks of the standing and the asking.
5. *Verify.*  Tasks hold probes against those that stand there by bit counts,
   in blocks; where a group is large, members already reached by links are not
   held against the rest again.  A task gives a star for each component of what
   it found, never pairs, and components of all stars are the result.

Every pair within ``most`` bits is met, whatever the allotment: the counts only
steer the cost.

Defined results: null and empty texts and texts without words have fingerprint
zero and link like others; fewer words than a shingle are one shingle; repeated
shingles count as often; rows that repeat an id stay rows; a row without an id
takes part and is named by its component (null if that has no id at all); extra
columns are ignored; an empty table gives an empty result; texts are taken
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk
from .shared import checkpoint, connected_components, small, stored

BITS, SEED = 64, 42
#: Leading bits of a part whose values are counted.
COUNTED = 16
MOST_RADIUS = 2
#: Numbers of parts that are weighed against each other.
OPTIONS = 4
#: Cost of a probe as a row of an exchange, in bit counts of candidates.
PROBE_COST = 64
#: Members of a block of one value; rows that a task takes; pairs held at once.
BLOCK, PACK_ROWS, PAIRS = 1 << 14, 1 << 15, 1 << 20
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space between: (bytes, starts, ends, word offsets by text)."""
    data, offsets = tk.utf8(column)
    data = tk.lower_ascii(data)
    flags = ~tk.space_flags(data)
    starts, ends, words = tk.spans(flags, offsets)
    size = ends - starts
    new = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[np.repeat(new - starts, size) + np.flatnonzero(flags)] = data[flags]
    return out.tobytes(), new, new + size, words


def fingerprints(column: pa.Array, n: int) -> np.ndarray:
    """The fingerprint of each text."""
    data, starts, ends, words = _joined(column)
    count = np.diff(words)
    shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    of = np.repeat(np.arange(len(count)), shingles)
    first = words[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + n, words[1:][of]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(of))
    # eight counters of a byte each are one word; at most 255 hashes are added before they are widened
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    begin = (np.cumsum(shingles) - shingles)[shingles > 0]
    runs = np.concatenate([np.arange(a, a + k, 255) for a, k in zip(begin.tolist(), shingles[shingles > 0].tolist(), strict=True)]) if len(begin) else begin
    ones = np.zeros((len(count), BITS), np.int64)
    if len(runs):
        part = np.add.reduceat(lanes, runs, axis=0).view(np.uint8).reshape(len(runs), BITS)
        ones[shingles > 0] = np.add.reduceat(part, np.searchsorted(runs, begin), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def correlated_parts(ones: np.ndarray, both: np.ndarray, total: int, m: int) -> list[np.ndarray]:
    """Bits in m parts of about equal widths: each begins with the most correlated free pair and takes the free bit most correlated with it."""
    mean = ones / max(total, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    relation = np.abs(both / max(total, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(relation, 0)
    free, parts = list(range(len(ones))), []
    for width in [len(ones) // m + (k < len(ones) % m) for k in range(m)]:
        own = relation[np.ix_(free, free)]
        part = [free[int(own.max(axis=1).argmax())]]
        while len(part) < width:
            rest = [b for b in free if b not in part]
            part.append(rest[int(relation[np.ix_(rest, part)].sum(axis=1).argmax())])
        free = [b for b in free if b not in part]
        parts.append(np.array(sorted(part)))
    return parts


def values_of(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of a part as a number, its first bit lowest."""
    out = np.zeros(len(prints), np.uint64)
    for k, b in enumerate(bits.tolist()):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All changes of at most ``radius`` of ``width`` bits."""
    shells = [np.zeros(1, np.uint64)]
    for _ in range(radius):
        low = shells[-1]
        above = [low[low < (1 << k)] | np.uint64(1 << k) for k in range(width)]
        shells.append(np.concatenate(above))
    return np.concatenate(shells)


def near_counts(counts: np.ndarray, width: int) -> np.ndarray:
    """(radius + 1, values): members within each radius of a value of the leading bits; further bits of the part count as even."""
    lead = counts.shape[0].bit_length() - 1
    shells = [counts.astype(np.float64)]
    at = np.arange(counts.shape[0], dtype=np.uint64)
    for r in range(1, MOST_RADIUS + 1):
        masks = _masks(lead, r)[len(_masks(lead, r - 1)):] if lead >= r else np.zeros(0, np.uint64)
        shells.append(sum((counts[(at ^ x).astype(np.intp)] for x in masks), np.zeros(len(counts))))
    rest = width - lead
    exact = [sum(shells[j] * comb(rest, r - j) for j in range(r + 1)) / 2.0**rest for r in range(MOST_RADIUS + 1)]
    return np.cumsum(exact, axis=0)


class Allotment:
    """Parts and what a probe of each value of their leading bits meets."""

    def __init__(self, parts: list[np.ndarray], counts: list[np.ndarray], most: int):
        self.parts, self.most, self.total = parts, most, most - len(parts) + 1
        self.near = [near_counts(c, len(b)).astype(np.float32) for b, c in zip(parts, counts, strict=True)]
        self.probes = [np.cumsum([comb(len(b), r) for r in range(MOST_RADIUS + 1)]) for b in parts]

    def rows(self, limits: np.ndarray) -> int:
        """Rows under which fingerprints of these thresholds stand and ask."""
        return limits.size + sum(int(self.probes[i][t]) * int(np.count_nonzero(limits[:, i] == t)) for i in range(len(self.parts)) for t in range(MOST_RADIUS + 1))

    def thresholds(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(thresholds by part, -1 and up; expected cost) of each fingerprint, by dynamic programming over parts."""
        m = len(self.parts)
        # state: sum of thresholds so far, plus one for each part
        width = self.total + m + 1
        best = np.full((len(prints), width), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((m, len(prints), width), np.int8)
        for i, bits in enumerate(self.parts):
            lead = (values_of(prints, bits) & np.uint64(len(self.near[i][0]) - 1)).astype(np.intp)
            after = np.full_like(best, np.inf)
            for t in range(-1, MOST_RADIUS + 1):
                cost = self.near[i][t][lead] + PROBE_COST * self.probes[i][t] if t >= 0 else np.zeros(len(prints))
                for s in range(width - t - 1):
                    own = best[:, s] + cost
                    better = own < after[:, s + t + 1]
                    after[better, s + t + 1] = own[better]
                    chosen[i, better, s + t + 1] = t
            best = after
        state = np.full(len(prints), width - 1)
        out = np.zeros((len(prints), m), np.int8)
        rows = np.arange(len(prints))
        for i in reversed(range(m)):
            out[:, i] = chosen[i, rows, state]
            state = state - out[:, i] - 1
        return out, best[:, -1]


def _reach(asking: np.ndarray, standing: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between the two sides, both sorted and distinct.

    From each start, unvisited fingerprints of the other side are reached and
    taken out, so a family is left after a few steps, not after all its pairs.
    """
    free = [np.ones(len(asking), bool), np.ones(len(standing), bool)]
    sides, found = (asking, standing), [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for start in range(len(asking)):
        if not free[0][start]:
            continue
        free[0][start] = False
        front, side = asking[start:start + 1], 0
        while len(front):
            other, got = 1 - side, []
            for k in range(0, len(front), 64):
                open_ = np.flatnonzero(free[other])
                if not len(open_):
                    break
                for at in np.array_split(open_, max(1, len(open_) * 64 // PAIRS)):
                    near = np.bitwise_count(front[k:k + 64, None] ^ sides[other][at][None, :]) <= most
                    hit = near.any(axis=0)
                    got.append(sides[other][at[hit]])
                    found.append((front[k:k + 64][near[:, hit].argmax(axis=0)], got[-1]))
                    free[other][at[hit]] = False
            front, side = np.concatenate(got) if got else front[:0], other
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) of the components of links, members beside the least alone."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(names))
    return names[off], names[label[off]]


def links_of(part: np.ndarray, value: np.ndarray, tile: np.ndarray, prints: np.ndarray, asks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links between asking and standing fingerprints of equal (part, value, tile)."""
    order = np.lexsort((prints, asks, tile, value, part))
    part, value, tile, prints, asks = part[order], value[order], tile[order], prints[order], asks[order]
    head = np.ones(len(order), bool)
    head[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (tile[1:] != tile[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(order))
    standing = np.add.reduceat(~asks, begin) if len(begin) else begin
    middle = begin + standing  # those that ask come second
    n, k = standing, end - middle
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]

    def settle() -> None:
        found[:] = [_stars(*(np.concatenate(x) for x in zip(*found, strict=True)))]

    for g in np.flatnonzero(n * k > PAIRS).tolist():
        found.append(_reach(prints[middle[g]:end[g]], prints[begin[g]:middle[g]], most))
    use = np.flatnonzero((n * k > 0) & (n * k <= PAIRS))
    pairs = (n * k)[use]
    cuts = np.searchsorted(np.cumsum(pairs), np.arange(PAIRS, int(pairs.sum()) + PAIRS, PAIRS)) if len(use) else []
    at = 0
    for cut in [*cuts, len(use)]:
        own = use[at:cut]
        at = max(at, cut)
        if not len(own):
            continue
        of = np.repeat(own, (n * k)[own])
        nth = np.arange(len(of)) - np.repeat(np.cumsum((n * k)[own]) - (n * k)[own], (n * k)[own])
        x, y = prints[begin[of] + nth // k[of]], prints[middle[of] + nth % k[of]]
        near = (np.bitwise_count(x ^ y) <= most) & (x != y)
        found.append((x[near], y[near]))
        if sum(len(v[0]) for v in found) > PAIRS:
            settle()
    settle()
    return found[0]


def linked(prints: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): stars whose components are those of the links of the distinct fingerprints (print bigint)."""

    def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            total += len(bits)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([both.ravel().tolist()], pa.list_(pa.int64()))], names=["total", "both"])

    seen = prints.mapInArrow(table_of, "total bigint, both array<bigint>").select("total", F.posexplode("both")).groupBy("pos").agg(F.sum("col").alias("n"), F.sum("total").alias("total")).collect()
    if not seen:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    total, both = seen[0]["total"], np.zeros(BITS * BITS)
    for row in seen:
        both[row["pos"]] = row["n"]
    both = both.reshape(BITS, BITS)

    fewest = -(-(most + 1) // (MOST_RADIUS + 1))
    chosen = [correlated_parts(both.diagonal(), both, total, m) for m in range(fewest, min(fewest + OPTIONS, most + 2))]
    flat = [bits for parts in chosen for bits in parts]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << min(COUNTED, len(bits)), np.int64) for bits in flat]
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for c, bits in zip(counts, flat, strict=True):
                c += np.bincount((values_of(own, bits) & np.uint64(len(c) - 1)).astype(np.intp), minlength=len(c))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at])], names=["part", "value", "n"])

    # at most 2^16 values for each of nine parts, whatever the table
    counted = prints.mapInArrow(histogram, "part int, value int, n bigint").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    counts = [np.zeros(1 << min(COUNTED, len(bits)), np.int64) for bits in flat]
    of, value, n = (counted.column(c).to_numpy() for c in ("part", "value", "n"))
    for i, c in enumerate(counts):
        c[value[of == i]] = n[of == i]
    options, leads, at = [], [], 0
    for parts in chosen:
        leads.append(counts[at:at + len(parts)])
        options.append(Allotment(parts, leads[-1], most))
        at += len(parts)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, n = np.zeros(len(options)), np.zeros(len(options), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for k, o in enumerate(options):
                limits, cost = o.thresholds(own)
                spent[k] += cost.sum()
                n[k] += o.rows(limits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(options)), pa.int32()), pa.array(spent), pa.array(n)], names=["option", "cost", "n"])

    best = prints.mapInArrow(costs, "option int, cost double, n bigint").groupBy("option").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).orderBy("cost", "option").first()
    plan = options[best["option"]]
    # under one value: what of its leading bits' count is beyond an even share, and that share
    crowds = []
    for c, bits in zip(leads[best["option"]], plan.parts, strict=True):
        even = 2 * total / len(c)
        crowds.append(np.where(c > 0, np.maximum(1, np.ceil((np.maximum(c - even, 0) + c / 2.0 ** (len(bits) - len(c).bit_length() + 1)) / BLOCK)), 0).astype(np.int64))
    masks = [_masks(len(bits), MOST_RADIUS) for bits in plan.parts]
    n_masks = plan.probes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                own = whole.column(0).to_numpy()[k:k + 4096].view(np.uint64)
                limits, _ = plan.thresholds(own)
                for i, bits in enumerate(plan.parts):
                    value = values_of(own, bits)
                    out = [(value, own, np.zeros(len(own), bool))]
                    for t in range(MOST_RADIUS + 1):
                        asks = np.flatnonzero(limits[:, i] == t)
                        if len(asks):
                            near = masks[i][:int(n_masks[i][t])]
                            out.append(((value[asks, None] ^ near[None, :]).ravel(), np.repeat(own[asks], len(near)), np.ones(len(asks) * len(near), bool)))
                    value, prints_, asks = (np.concatenate(x) for x in zip(*out, strict=True))
                    # tiles: standing members of a crowded value in blocks, those that ask in as many
                    blocks = crowds[i][(value & np.uint64(len(crowds[i]) - 1)).astype(np.intp)]
                    some = blocks > 0  # nobody stands under other values
                    value, prints_, asks, blocks = value[some], prints_[some], asks[some], blocks[some]
                    own_block = (tk.mix(prints_) % blocks.astype(np.uint64)).astype(np.int64)
                    again = np.repeat(np.arange(len(value)), blocks)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    tile = np.where(asks[again], other * blocks[again] + own_block[again], own_block[again] * blocks[again] + other)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(again), i), pa.int32()), pa.array(value[again].view(np.int64)), pa.array(tile), pa.array(prints_[again].view(np.int64)), pa.array(asks[again])], names=["part", "value", "tile", "print", "asks"])

    schema = "part int, value bigint, tile bigint, print bigint, asks boolean"
    packs = best["n"] // PACK_ROWS + 1
    dealt = prints.mapInArrow(rows, schema).withColumn("pack", F.pmod(F.xxhash64("part", "value", "tile"), F.lit(packs)))

    def verify(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("part", "value", "tile", "print")}
        a, b = links_of(columns["part"], columns["value"].view(np.uint64), columns["tile"], columns["print"].view(np.uint64), np.array(table.column("asks")), most)
        tk.trim()
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("pack").applyInArrow(verify, "a bigint, b bigint")


def components(docs: DataFrame, n: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row: 16 hex digits, and the smallest id that links reach."""
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fingerprints(block.column(1), n).view(np.int64))], names=["key", "print"])

    marked = stored(rows.mapInArrow(run, f"key {kind}, print bigint"))
    named = checkpoint(marked.groupBy("print").agg(F.min("key").alias("least")))
    labels = checkpoint(connected_components(linked(named.select("print"), most)))
    lowest = named.join(labels, named["print"] == labels["node"]).groupBy("component").agg(F.min("least").alias("low"))
    together = labels.join(lowest, "component").select(F.col("node").alias("print"), "low")
    resolved = named.join(together, "print", "left").select("print", F.coalesce("low", "least").alias("component_id"))
    result = marked.join(small(checkpoint(resolved)), "print")
    return result.select(F.col("key").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
