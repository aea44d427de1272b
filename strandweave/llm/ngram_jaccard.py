"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Documents with equal shingle sets are one class; links are sought between
classes.

1. *Bands.*  Set sizes are cut into bands so wide that linked sets lie in the
   same band or in neighbouring ones.  A level is a band with the next.
2. *Candidates, without loss.*  Sets of one level that link differ in at most D
   shingles, D fixed by the level.  Each level cuts the hash range into
   D // 2 + 1 + spare bundles of three parts each, so at least 1 + spare bundles
   of two linked sets differ in one shingle at most, and two of their three
   parts are equal: a set emits a hash for every two parts of a bundle that are
   not both empty.  A set in which more than ``spare`` bundles have two empty
   parts emits the hashes of another cut as well, and so on; where two sets
   link, the first cut that suits one of them gives both an equal hash.  Spare
   bundles are raised where too few cuts would suit a level's smallest sets.
   Where no number does (thresholds below 0.73 or so), each shingle of the
   level's sets is a hash; a set that no cut suits is an error.  Hashes travel as packed arrays, one row per task, flush and hash range.
3. *Meetings.*  Classes with an equal hash meet in a list; equal lists are one.
   Every member meets the list's pivot, the member that shares most.  First each
   class is held against the pivot with which it shares most hashes, then
   against the other pivots that it is not yet connected with.
4. *Tiles.*  Where a list still has members of different components, its members
   meet in tiles of bounded size, a band with itself and with the next.
5. *Bounds.*  Hashed bitmaps bound each pair's overlap from above by bit counts;
   only texts of pairs that the bound admits travel, and are intersected exactly
   as sorted arrays, satellites beside their hub, salted beyond a pack's bytes.
   Components are those of links found so; no candidate joins one unverified.

Hashes have 64 bits.  A link needs q * |A & B| >= p * |A | B| for the threshold
p / q.

Defined results: texts without words (null, empty, white space) have no
shingles and link with nothing, their component is their own id; a text with
fewer words than a shingle is one shingle.  Rows that repeat an id are one
document and must repeat its text.  A row with a null id takes part where its
text has an id elsewhere, and its class's smallest id names it (null if there is
none).  Extra columns are ignored; an empty table gives an empty result; texts
are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_kernels as tk
from .shared import checkpoint, connected_components, release, small, stored

#: Set bytes that one task verifies at once.
GROUP_BYTES = 4 << 20
#: Members of one list and band that a tile takes.
TILE = 2048
BUCKET_HASHES = 1 << 20
FLUSH_HASHES = 1 << 19
LARGEST_SET = 1 << 40
#: Cuts that a set tries; the share of cuts that must suit a level's smallest sets, and that which further spare bundles are to give.
CUTS, LEAST_FIT, FIT = 400, 0.1, 0.5
#: Throws that estimate the share, for sets of up to so many shingles; beyond, parts fill as a normal law has it.
THROWS, THROWN = 200, 512
MOST_BITS = 1 << 16
_PART = np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0xC13FA9A902A6328F)
_COUNT = np.uint64(0x91E10DA5C79E7B1D)
_CUT = np.uint64(0xB5297A4D3F84C2E3)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text, and their n + 1 offsets."""
    data, starts, ends, words = tk.words_of(texts)
    hashes = tk.hash_spans(data, starts, ends)
    windows = tk.ngram_hashes(hashes, n)
    count = np.diff(words)
    short = (count > 0) & (count < n)
    offsets = np.zeros(len(words), np.int64)
    np.cumsum(np.where(short, 1, np.maximum(count - n + 1, 0)), out=offsets[1:])
    sets = np.empty(offsets[-1], np.uint64)
    of = tk.value_index(words)
    slots = np.ones(len(sets), bool)
    slots[offsets[:-1][short]] = False
    if len(windows):
        sets[slots] = windows[of[:len(windows)] == of[len(of) - len(windows):]]
    for i in np.flatnonzero(short).tolist():
        sets[offsets[i]] = tk.mix(tk.ngram_hashes(hashes[words[i]:words[i + 1]], int(count[i])) + np.uint64(count[i]))[0]
    edges = offsets.tolist()
    for a, b in zip(edges, edges[1:]):
        sets[a:b].sort()
    new = np.ones(len(sets), bool)
    new[1:] = sets[1:] != sets[:-1]
    new[offsets[:-1][offsets[:-1] < len(sets)]] = True
    return sets[new], np.concatenate([[0], np.cumsum(tk.sums_by_value(new, offsets))])


def set_hash(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(tk.mix(sets), out=total[1:])
    return tk.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _COUNT)


def fitting(n: int, bundles: int, spare: int) -> float:
    """The share of cuts into so many bundles that leave a set of ``n`` at most ``spare`` bundles with two empty parts."""
    if n < 2 * (bundles - spare):
        return 0.0
    if n > THROWN:
        empty = (1 - 1 / (3 * bundles)) ** n
        bad = 3 * empty**2 * (1 - empty) + empty**3
        width = math.sqrt(2 * bundles * bad * (1 - bad))
        return 0.5 * (1 + math.erf((spare + 0.5 - bundles * bad) / max(width, 1e-9)))
    filled = np.zeros((THROWS, 3 * bundles), bool)
    filled[np.arange(THROWS)[:, None], np.random.default_rng(n).integers(0, 3 * bundles, (THROWS, n))] = True
    bad = (filled.reshape(THROWS, bundles, 3).sum(-1) < 2).sum(-1)
    return float((bad <= spare).mean())


class Bands:
    """Size bands for the threshold p / q, and the bundles of each level."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        lows = [1]
        while lows[-1] < LARGEST_SET:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * q // p)))
        self.lows = np.array(lows, np.int64)
        self.differences = (self.lows[1:] - 1) * (q - p) // p
        self.spare = np.where(self.differences > 1, 1 + self.differences // 24, 0)
        self.plain = np.zeros(len(self.differences), bool)
        for level in np.flatnonzero(self.differences):
            low, d, spare = lows[level], int(self.differences[level]), int(self.spare[level])
            least = LEAST_FIT
            while fitting(low, d // 2 + 1 + spare, spare) < least and not self.plain[level]:
                spare, least = spare + 1 + spare // 8, FIT
                self.plain[level] = spare > 2 * d
            self.spare[level] = spare
        self.bundles = self.differences // 2 + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def part_hashes(self, sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the set) for every two parts of a bundle, on the set's band's level and the one below."""
        sizes = np.diff(offsets)
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for down in (0, 1):
            level = self.of(np.maximum(sizes, 1)) - down
            use = (sizes > 0) & (level >= 0)
            use &= self.differences[np.maximum(level, 0)] > 0  # else only equal sets can link
            plain = use & self.plain[np.maximum(level, 0)]
            for number in np.flatnonzero(plain).tolist():
                hashes.append(tk.mix(sets[offsets[number]:offsets[number + 1]] ^ tk.mix(level[number:number + 1].astype(np.uint64) + _LEVEL)))
                owners.append(np.full(int(sizes[number]), number))
            mine = np.flatnonzero(use & ~plain)
            for cut in range(CUTS):
                if not len(mine):
                    break
                found, own, unfit = self._cut(sets, offsets, mine, level[mine], cut)
                hashes.append(found)
                owners.append(own)
                mine = unfit
            if len(mine):
                raise RuntimeError(f"{len(mine)} sets suit none of {CUTS} cuts")
        return np.concatenate(hashes), np.concatenate(owners)

    def _cut(self, sets: np.ndarray, offsets: np.ndarray, mine: np.ndarray, level: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and owners of one cut of the hash range, and the sets that need another."""
        n, k = (offsets[1:] - offsets[:-1])[mine], self.bundles[level]
        at = np.repeat(offsets[:-1][mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        turn = np.uint64(cut * int(_CUT) % (1 << 64))
        values = sets[at] if not cut else tk.mix(sets[at] ^ turn)
        base = np.cumsum(3 * k) - 3 * k
        slot = (((values >> np.uint64(32)) * np.repeat(3 * k, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + np.repeat(base, n)
        total = int(3 * k.sum())
        count = np.bincount(slot, minlength=total)
        sums = np.zeros(total, np.uint64)
        if cut:
            np.add.at(sums, slot, values)
        else:  # sets are sorted, so parts are runs
            running = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values, out=running[1:])
            edges = np.concatenate([[0], np.cumsum(count)])
            sums = running[edges[1:]] - running[edges[:-1]]
        count, sums = count.reshape(-1, 3), sums.reshape(-1, 3)
        rest = count.sum(1, keepdims=True) - count
        owner = np.repeat(np.arange(len(mine)), k)
        number = (np.arange(total).reshape(-1, 3) - base[owner][:, None]).astype(np.uint64)
        salt = level[owner].astype(np.uint64) * _LEVEL + turn
        hashed = tk.mix(sums.sum(1, keepdims=True, dtype=np.uint64) - sums + rest.astype(np.uint64) * _COUNT + (number + np.uint64(1)) * _PART + salt[:, None])
        keep = rest > 0
        bad = np.bincount(owner, (~keep).any(1), minlength=len(mine))
        return hashed[keep], np.repeat(mine[owner], 3)[keep.ravel()], mine[bad > self.spare[level]]


def bitmaps(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A hashed bitmap per set, of four bits or more per shingle up to MOST_BITS."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        bits = 256
        while bits < min(4 * (b - a), MOST_BITS):
            bits *= 2
        flags = np.zeros(bits, np.uint8)
        flags[(sets[a:b] & np.uint64(bits - 1)).astype(np.intp)] = 1
        out.append(np.packbits(flags).tobytes())
    return out


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap as words, folded to ``size`` bytes: the lower bits of the same hashes."""
    data = np.frombuffer(bitmap, np.uint64)
    return np.bitwise_or.reduce(data.reshape(-1, size // 8), axis=0) if 8 * len(data) > size else data


def admitted(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, p: int, q: int) -> np.ndarray:
    """Pairs whose overlap may reach the threshold by their bitmaps' bit counts: sizes n and m, bitmaps as rows."""
    bound = np.minimum(n - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
    return q * bound >= p * (n + m - bound)


def _pack_rows(held: list, bits: int) -> pa.RecordBatch:
    """One row per hash range: (bucket, hashes ascending, nodes), packed."""
    hashes, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(hashes)
    hashes, nodes = hashes[order], nodes[order]
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    cuts = [0, *np.searchsorted(hashes, inner).tolist(), len(hashes)]
    rows = [(k, tk.pack(hashes[a:b], True), nodes[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    k, h, v = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.binary()), pa.array(v, pa.binary())], names=["bucket", "hashes", "nodes"])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the one before."""
    head = np.zeros(len(columns[0]), bool)
    head[:1] = True
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    return head


def _meet(table: pa.Table) -> pa.Table:
    """Of one hash range: pairs (a, pivot b, hashes shared), and the distinct lists of three and more."""
    hashes = np.concatenate([tk.unpack(x, np.uint64, True) for x in table.column("hashes").to_pylist()])
    nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
    order = np.argsort(hashes)
    own = hashes[order]
    same = np.zeros(len(own), bool)
    same[1:] = own[1:] == own[:-1]
    same[:-1] |= same[1:]
    order = order[same]
    hashes, nodes = hashes[order], nodes[order]
    order = np.lexsort((nodes, hashes))
    hashes, nodes = hashes[order], nodes[order]
    new = _heads(hashes, nodes)
    hashes, nodes = hashes[new], nodes[new]
    start = np.flatnonzero(_heads(hashes))
    size = np.diff(np.append(start, len(hashes)))
    # lists of two and more; equal lists are one, with the number of their hashes
    member = np.repeat(size > 1, size)
    nodes, start, size = nodes[member], None, size[size > 1]
    start = np.cumsum(size) - size
    running = np.zeros(len(nodes) + 1, np.uint64)
    np.cumsum(tk.mix(nodes.view(np.uint64)), out=running[1:])
    lid = tk.mix(running[start + size] - running[start] + size.astype(np.uint64) * _COUNT)
    _, first, weight = np.unique(lid, return_index=True, return_counts=True)
    at = np.repeat(start[first] - (np.cumsum(size[first]) - size[first]), size[first]) + np.arange(int(size[first].sum()))
    nodes, lid, size = nodes[at], lid[first], size[first]
    start = np.cumsum(size) - size
    # the pivot shares most: the member with the largest sum of list sizes
    names, number = np.unique(nodes, return_inverse=True)
    of = np.repeat(np.arange(len(size)), size)
    degree = np.bincount(number, (size * weight)[of], minlength=len(names)).astype(np.int64)
    best = np.lexsort((nodes, -degree[number], of))[start] if len(start) else start
    pivot = nodes[best][of]
    a, b, w = nodes[nodes != pivot], pivot[nodes != pivot], weight[of][nodes != pivot]
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    head = np.flatnonzero(_heads(a, b)) if len(a) else np.zeros(0, np.int64)
    w = np.add.reduceat(w, head) if len(head) else w
    long = np.flatnonzero(size > 2)
    lists = [nodes[start[i]:start[i] + size[i]].tobytes() for i in long.tolist()]
    none = lambda k, kind: pa.nulls(k, kind)
    pairs, kept = len(head), len(long)
    tk.trim()
    return pa.table({
        "a": pa.concat_arrays([pa.array(a[head], pa.int64()), none(kept, pa.int64())]), "b": pa.concat_arrays([pa.array(b[head], pa.int64()), none(kept, pa.int64())]), "shared": pa.concat_arrays([pa.array(w, pa.int64()), none(kept, pa.int64())]),
        "lid": pa.concat_arrays([none(pairs, pa.int64()), pa.array(lid[long].view(np.int64), pa.int64())]), "members": pa.concat_arrays([none(pairs, pa.binary()), pa.array(lists, pa.binary())]),
    })


def _meetings(texts: DataFrame, bands: Bands, n: int, n_shingles: int) -> DataFrame:
    """(a, b, shared) pairs with pivots, and (lid, members) lists, of one table."""
    bits = max(0, (n_shingles * 3 // 4 // BUCKET_HASHES)).bit_length()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for block in tk.blocks(batches):
            sets, offsets = shingle_sets(block.column(0), n)
            nodes = set_hash(sets, offsets).view(np.int64)
            # copies emit once per flush
            fresh = [i for i, x in enumerate(nodes.tolist()) if x not in seen and not seen.add(x)]
            if len(fresh) < len(nodes):
                keep = np.zeros(len(nodes), bool)
                keep[fresh] = True
                sets = sets[np.repeat(keep, np.diff(offsets))]
                offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[keep])])
                nodes = nodes[keep]
            hashes, owners = bands.part_hashes(sets, offsets)
            if len(hashes):
                held.append((hashes, nodes[owners]))
                total += len(hashes)
            if total >= FLUSH_HASHES:
                yield _pack_rows(held, bits)
                total, seen = 0, set()
                tk.trim()
        if held:
            yield _pack_rows(held, bits)

    packed = texts.mapInArrow(emit, "bucket bigint, hashes binary, nodes binary")
    return packed.groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint, shared bigint, lid bigint, members binary")


class _Verifier:
    """Holds pairs of classes against their bitmaps, then their texts; ``classes`` is (node, n, bitmap, text)."""

    def __init__(self, classes: DataFrame, bands: Bands, n: int, group_bytes: int):
        self.classes, self.bands, self.n, self.group_bytes = classes, bands, n, group_bytes

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs (a, hub b)."""
        p, q, n, group_bytes = self.bands.p, self.bands.q, self.n, self.group_bytes
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"m_{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{p} * greatest(n_a, n_b) <= {q} * least(n_a, n_b)")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column(2).to_pylist(), batch.column(4).to_pylist()
                n_a, n_b = batch.column(1).to_numpy(), batch.column(3).to_numpy()
                least = np.array([min(len(s), len(t)) for s, t in zip(x, y, strict=True)], np.int64)
                keep = np.zeros(batch.num_rows, bool)
                for size in np.unique(least).tolist():
                    for at in np.array_split(np.flatnonzero(least == size), max(1, np.count_nonzero(least == size) * size >> 22)):
                        if len(at):
                            keep[at] = admitted(n_a[at], np.stack([_folded(x[i], size) for i in at]), n_b[at], np.stack([_folded(y[i], size) for i in at]), p, q)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5)], names=["a", "n_a", "b"]).filter(pa.array(keep))

        fit = checkpoint(sized.select("a", "n_a", "m_a", "n_b", "m_b", "b").mapInArrow(bound, "a bigint, n_a bigint, b bigint"))
        loads = checkpoint(fit.groupBy("b").agg(F.ceil(F.sum("n_a") * 8 / F.lit(group_bytes)).cast("long").alias("salts"), F.sum("n_a").alias("load")))
        packs = max(1, (loads.agg(F.sum("load")).first()[0] or 0) * 8 // group_bytes)
        placed = fit.join(small(loads.select("b", "salts")), "b").select("a", "b", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), "salts")), F.lit(packs)).alias("pack"))
        hubs = loads.select("b", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")).select("b", F.pmod(F.xxhash64("b", "salt"), F.lit(packs)).alias("pack")).distinct()
        text = lambda x: self.classes.select(F.col("node").alias(x), "text")
        rows = placed.join(text("a"), "a").select("pack", "b", "a", "text").unionByName(hubs.join(text("b"), "b").select("pack", "b", F.lit(None).cast("bigint").alias("a"), "text"))

        def verify(table: pa.Table) -> pa.Table:
            hubs = table.column("b").to_numpy()
            is_hub = np.array(table.column("a").is_null())
            sets = []
            for block in (b for batch in table.select(["text"]).to_batches() for b in tk.blocks([batch])):
                values, offsets = shingle_sets(block.column(0), n)
                edges = offsets.tolist()
                sets += [values[x:y] for x, y in zip(edges, edges[1:])]
            of_hub = {int(hubs[i]): sets[i] for i in np.flatnonzero(is_hub)}
            a, b = [], []
            own = table.column("a").to_pylist()
            for i in np.flatnonzero(~is_hub).tolist():
                x, y = sets[i], of_hub[int(hubs[i])]
                at = np.searchsorted(y, x)
                same = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                if q * same >= p * (len(x) + len(y) - same):
                    a.append(own[i])
                    b.append(int(hubs[i]))
            tk.trim()
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return checkpoint(rows.groupBy("pack").applyInArrow(verify, "a bigint, b bigint"))


def _labels(links: DataFrame) -> DataFrame:
    return checkpoint(connected_components(links))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not of one component."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where("NOT coalesce(c_a, a) <=> coalesce(c_b, b)").select("a", "b")


def _tiles(lists: DataFrame, labels: DataFrame, classes: DataFrame, bands: Bands, tile: int, group_bytes: int) -> DataFrame | None:
    """Pairs within lists, of different components, that their bitmaps admit; None if no list has two components."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lids, members = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in members], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lids, sizes)), pa.array(np.frombuffer(b"".join(members), np.int64))], names=["lid", "node"])

    rows = lists.select("lid", "members").mapInArrow(unpack, "lid bigint, node bigint").join(labels, "node", "left").select("lid", "node", F.coalesce("component", "node").alias("label"))
    # equal lists of other hash ranges fall together here
    open_ = rows.groupBy("lid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.countDistinct("node").alias("size")).where("low <> high").select("lid", "size")
    open_ = checkpoint(open_)
    if not open_.limit(1).count():
        return None
    held = rows.distinct().join(open_, "lid").join(classes.select("node", "n", "bitmap"), "node")
    blocks = F.ceil(F.col("size") / F.lit(tile)).cast("long")
    held = held.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # a member stands in the tiles of its block with every block
    dealt = held.select("lid", "node", "label", "n", "bitmap", "block", F.explode(F.expr("transform(sequence(0L, blocks - 1), k -> struct(least(k, block) AS x, greatest(k, block) AS y))")).alias("tile"))
    bytes_ = dealt.agg(F.sum(F.length("bitmap"))).first()[0] or 0
    packs = max(1, bytes_ // group_bytes)
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("lid", "tile"), F.lit(packs)))
    p, q = bands.p, bands.q

    def pairs_of(nodes: np.ndarray, labels_: np.ndarray, n: np.ndarray, block: np.ndarray, maps: list[bytes], one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(n, kind="stable")
        nodes, labels_, n, block, maps = nodes[order], labels_[order], n[order], block[order], [maps[i] for i in order]
        size = min(map(len, maps))
        matrix = np.stack([_folded(x, size) for x in maps])
        ends = np.searchsorted(p * n, q * n, "right")
        for i in range(len(nodes)):
            other = np.arange(i + 1, ends[i])
            other = other[labels_[other] != labels_[i]]
            if not one:
                other = other[block[other] != block[i]]
            if len(other):
                other = other[admitted(n[i], matrix[i], n[other], matrix[other], p, q)]
                yield np.full(len(other), nodes[i]), nodes[other]

    def tiles(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("lid", "node", "label", "n", "block", "x", "y")}
        order = np.lexsort((columns["y"], columns["x"], columns["lid"]))
        cuts = np.append(np.flatnonzero(_heads(*(columns[c][order] for c in ("lid", "x", "y")))), len(order)).tolist()
        maps = table.column("bitmap").to_pylist()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            one = columns["x"][at[0]] == columns["y"][at[0]]
            found += pairs_of(columns["node"][at], columns["label"][at], columns["n"][at], columns["block"][at], [maps[i] for i in at], one)
        x, y = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((np.maximum(x, y), np.minimum(x, y)))
        x, y = np.minimum(x, y)[order], np.maximum(x, y)[order]
        head = _heads(x, y)
        tk.trim()
        return pa.table({"a": pa.array(x[head]), "b": pa.array(y[head])})

    dealt = dealt.select("pack", "lid", "node", "label", "n", "block", "bitmap", "tile.x", "tile.y")
    return checkpoint(dealt.groupBy("pack").applyInArrow(tiles, "a bigint, b bigint").distinct())


def components(docs: DataFrame, n: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, tile: int = TILE) -> DataFrame:
    """(id, n_shingles, component_id) per row: component_id is the smallest id that links reach."""
    bands = Bands(p, q)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            sets, offsets = shingle_sets(block.column(1), n)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(set_hash(sets, offsets).astype(np.int64), pa.int64())], names=["key", "n", "node"])

    all_rows = checkpoint(rows.mapInArrow(measure, f"key {kind}, n bigint, node bigint").withColumn("node", F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64("key"))))
    named = all_rows.groupBy("n", "node").agg(F.min("key").alias("rep"))
    n_shingles = all_rows.agg(F.sum("n")).first()[0] or 0

    met = stored(_meetings(rows.select("text"), bands, n, n_shingles))
    release(spark, 8 * n_shingles)
    stars = checkpoint(met.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared")))
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    wanted = checkpoint(named.where("n > 0 AND rep IS NOT NULL").join(wanted, "node").select("node", F.col("rep").alias("key")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.blocks(batches):
            sets, offsets = shingle_sets(block.column(1), n)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(set_hash(sets, offsets).astype(np.int64), pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(bitmaps(sets, offsets), pa.binary()), block.column(1)], names=["key", "node", "n", "bitmap", "text"])

    own = rows.join(small(wanted.select("key").distinct()), "key", "left_semi").mapInArrow(gather, f"key {kind}, node bigint, n bigint, bitmap binary, text string")
    # an id whose rows differ may stand for several classes, each by its own text
    own = own.join(small(wanted), ["node", "key"], "left_semi")
    repeated = wanted.join(all_rows, ["node", "key"]).groupBy("node").count().where("count > 1").limit(1).count()
    classes = stored((own.dropDuplicates(["node"]) if repeated else own).select("node", "n", "bitmap", "text"))
    del own
    release(spark, 8 * n_shingles)

    verifier = _Verifier(classes, bands, n, group_bytes)
    best = checkpoint(stars.groupBy("a").agg(F.max(F.struct("shared", F.col("b"))).alias("best")).select("a", F.col("best.b").alias("b")))
    links = verifier.links(best)
    labels = _labels(links)
    links = checkpoint(links.union(verifier.links(_apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), labels))))
    labels = _labels(links)
    release(spark, 8 * n_shingles)
    tiled = _tiles(met.where("lid IS NOT NULL"), labels, classes, bands, tile, group_bytes)
    if tiled is not None:
        tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = verifier.links(tiled.join(tested, ["a", "b"], "left_anti"))
        labels = _labels(checkpoint(links.union(more)))
    lowest = named.join(labels, "node").groupBy("component").agg(F.min("rep").alias("low"))
    linked = labels.join(lowest, "component").select("node", "low")
    resolved = named.join(linked, "node", "left").select("n", "node", F.coalesce("low", "rep").alias("component_id"))
    result = all_rows.alias("r").join(resolved.alias("c"), F.expr("r.node = c.node AND r.n = c.n"))
    return result.select(F.col("r.key").alias(id_col), F.col("r.n").alias("n_shingles"), "c.component_id")
