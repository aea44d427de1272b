"""Interval, band and similarity joins without products of whole tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .materialise import checkpoint

#: Items that are multiplied with the prototypes at once.
ITEMS = 512
#: Rows up to which a counted side may be broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side that was counted and is small, else the side as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(rows: DataFrame, *excluded: DataFrame, key: str = "video_uid") -> DataFrame:
    """Rows whose key is in none of the tables."""
    keys = excluded[0].select(key)
    for e in excluded[1:]:
        keys = keys.union(e.select(key))
    return rows.join(keys.distinct(), key, "left_anti")


def null_safe_anti(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose whole key, nulls equal, is not in ``done``."""
    seen = done.select(*[F.col(k).alias(f"seen_{i}") for i, k in enumerate(keys)]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"seen_{i}")) for i, k in enumerate(keys)]
    match = on[0]
    for o in on[1:]:
        match = match & o
    return rows.join(seen, match, "left_anti")


#: Members of one (entity, cell) that a task ranks beside each other, and rows of a task.
CELL_ROWS, PACK_ROWS = 1 << 18, 1 << 19


def ranks_below(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of ``ranks[low:high]`` are under ``most``, for many ranges at once: sorted runs of doubling lengths, of which a range takes two of each at most."""
    out = np.zeros(len(low), np.int64)
    low, high = low.copy(), np.maximum(high, low)
    at, size = np.arange(len(ranks)), 1
    while (low < high).any():
        key = np.sort((at // size) * (len(ranks) + 1) + ranks)

        def under(run: np.ndarray, use: np.ndarray) -> None:
            found = np.searchsorted(key, run[use] * (len(ranks) + 1) + most[use]) - run[use] * size
            out[use] += found

        left = (low < high) & (low // size % 2 == 1)
        under(low // size, left)
        low = np.where(left, low + size, low)
        right = (low < high) & (high // size % 2 == 1)
        under(high // size - 1, right)
        high = np.where(right, high - size, high)
        size *= 2
    return out


def _members(table: pa.Table) -> pa.Table:
    """(id, n): for each container of a pack, its members among those of its part."""
    part, a, b = (table.column(c).to_numpy() for c in ("part", "a", "b"))
    id_ = table.column("id")
    asks = np.array(id_.is_valid())
    order = np.lexsort((a[~asks], part[~asks]))
    own, start, end = part[~asks][order], a[~asks][order], b[~asks][order]
    ends, rank = np.unique(end, return_inverse=True)
    # the first member of the container's part that begins with it or later
    at = np.lexsort((np.append(np.ones(len(own), np.int8), np.zeros(int(asks.sum()), np.int8)), np.append(start, a[asks]), np.append(own, part[asks])))
    before = np.cumsum(at < len(own))
    low = np.empty(len(at), np.int64)
    low[at] = before
    low = low[len(own):]
    high = np.searchsorted(own, part[asks], "right")
    n = ranks_below(rank, low, high, np.searchsorted(ends, b[asks], "right"))
    return pa.table({"id": id_.filter(pa.array(asks)), "n": pa.array(n)})


def containment_counts(intervals: DataFrame, split: float = 10.0, cell: float | None = None) -> DataFrame:
    """Adds ``density``: shorter intervals (under ``split``) of the entity inside each longer one; 0 for shorter ones.

    intervals: (id, video_uid, cs, ce, ...); a cell of time is at least
    ``split``.  Cells that a long interval covers with a cell to spare are
    counted by running sums of their short ones; of the up to three others it
    counts the members by ranks.  No pair of a container and a member is a row:
    a long interval is one for each of its open cells, times the parts into
    which crowded ones are dealt, whose counts add up.
    """
    cell = max(cell or split, split)
    length = F.col("ce") - F.col("cs")
    intervals = checkpoint(intervals)  # what made them is not run again for each use
    own = intervals.select("id", "video_uid", "cs", "ce")
    short = own.where(length < split).select("video_uid", F.floor(F.col("cs") / cell).alias("cell"), F.col("cs").cast("double").alias("a"), F.col("ce").cast("double").alias("b"))
    long_ = own.where(length >= split).select("id", "video_uid", F.col("cs").cast("double").alias("a"), F.col("ce").cast("double").alias("b"), F.floor(F.col("cs") / cell).alias("first"), F.floor(F.col("ce") / cell).alias("last"))
    counts = checkpoint(short.groupBy("video_uid", "cell").agg(F.count("*").alias("n")))
    # members in cells after the first and two or more before the last lie inside
    wanted = long_.where("last - 2 > first").select("video_uid", F.explode(F.array("first", F.col("last") - 2)).alias("cell")).distinct()
    both = counts.select("video_uid", "cell", "n", F.lit(0).alias("w")).unionByName(wanted.select("video_uid", "cell", F.lit(0).cast("long").alias("n"), F.lit(1).alias("w")))
    upto = checkpoint(both.withColumn("upto", F.sum("n").over(Window.partitionBy("video_uid").orderBy("cell", "w").rowsBetween(Window.unboundedPreceding, 0))).where("w = 1").select("video_uid", "cell", "upto"))
    ends = lambda c, name: upto.select("video_uid", F.col("cell").alias(c), F.col("upto").alias(name))
    inner = long_.where("last - 2 > first").withColumn("end", F.col("last") - 2).join(ends("first", "low"), ["video_uid", "first"]).join(ends("end", "high"), ["video_uid", "end"]).select("id", (F.col("high") - F.col("low")).alias("n"))
    open_ = long_.withColumn("cell", F.explode(F.array_distinct(F.array("first", F.greatest("first", F.col("last") - 1), "last"))))
    parts = counts.select("video_uid", "cell", F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int").alias("parts"))
    asked = open_.join(parts, ["video_uid", "cell"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = short.join(parts, ["video_uid", "cell"]).withColumn("k", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"))
    packs = (counts.agg(F.sum("n")).first()[0] or 0) // PACK_ROWS * 3 + intervals.sparkSession.sparkContext.defaultParallelism
    part = F.xxhash64("video_uid", "cell", "k").alias("part")
    rows = asked.select("id", part, "a", "b").unionByName(held.select(F.lit(None).cast(intervals.schema["id"].dataType).alias("id"), part, "a", "b"))
    kind = intervals.schema["id"].dataType.simpleString()
    found = rows.withColumn("pack", F.pmod("part", F.lit(packs))).groupBy("pack").applyInArrow(_members, f"id {kind}, n bigint")
    total = found.unionByName(inner).groupBy("id").agg(F.sum("n").alias("n_"))
    return intervals.join(total, "id", "left").withColumn("density", F.coalesce("n_", F.lit(0)).cast("long")).drop("n_")


def rows_in_range(queries: DataFrame, narrations: DataFrame, cell: float = 64.0) -> DataFrame:
    """The entity's rows in [s, e] of each query, by an equality join on cells of time.

    queries: (query_id, video_uid, s, e, ...); a query without both ends meets nothing.
    """
    cells = queries.select("query_id", "video_uid", "s", "e").where("s <= e").withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor(F.col("e") / cell))))
    rows = narrations.select("video_uid", "timestamp_sec", "narration_uid", "narration_text", F.floor(F.col("timestamp_sec") / cell).alias("cell"))
    return cells.join(rows, ["video_uid", "cell"]).where(F.col("timestamp_sec").between(F.col("s"), F.col("e"))).drop("cell")


def texts_in_range(queries: DataFrame, narrations: DataFrame, cell: float = 64.0) -> DataFrame:
    """Adds ``text``: the texts of the entity's rows in [s, e], by time, joined by blanks; empty if there are none."""
    met = rows_in_range(queries, narrations, cell)
    line = F.struct("timestamp_sec", "narration_uid", "narration_text")
    text = met.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["narration_text"]), " ").alias("text_"))
    return queries.join(text, "query_id", "left").withColumn("text", F.coalesce("text_", F.lit(""))).drop("text_")


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float) -> DataFrame:
    """Pairs with |left_value - right_value| <= width, by an equality join on cells of that width."""
    at = F.floor(F.col(left_value) / width)
    spread = left.withColumn("cell_", F.explode(F.array(at - 1, at, at + 1)))
    return spread.join(right.withColumn("cell_", F.floor(F.col(right_value) / width)), "cell_").where(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("cell_")


#: Rows of either side that a task of band_counts() holds at once.
LEFT_ROWS, RIGHT_ROWS = 1 << 18, 1 << 20


def least_in_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for many ranges with a value at once: minima of runs of doubling lengths, of which a range takes two of one length."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp(high - low)[1] - 1
    runs = values
    for k in range(int(level.max(initial=-1)) + 1):
        use = np.flatnonzero(level == k)
        out[use] = np.minimum(runs[low[use]], runs[high[use] - (1 << k)])
        runs = np.minimum(runs[:-(1 << k)], runs[1 << k:]) if len(runs) > 1 << k else runs
    return out


def _band(width: float):
    """(key, n, first) of the left rows that meet right ones."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g, key = left.column("v").to_numpy(), left.column("key")
        h, at = np.unique(right.column("v").to_numpy(), return_inverse=True)
        upto = np.append(0, np.cumsum(np.bincount(at, minlength=len(h))))
        other = right.column("other").combine_chunks()
        # the least key of each value by its rank; nulls have none
        rank = np.empty(len(other), np.int64)
        order = pc.sort_indices(other, null_placement="at_end")
        rank[order.to_numpy()] = np.arange(len(other))
        rank[other.is_null().to_numpy(zero_copy_only=False)] = len(other)
        first = np.full(len(h), len(other))
        np.minimum.at(first, at, rank)
        low, high = np.searchsorted(h, g - width), np.searchsorted(h, g + width, "right")
        # the difference as rounded decides, one value more or less at either end
        inside = lambda i: (i >= 0) & (i < len(h)) & (np.abs(g - h[np.clip(i, 0, len(h) - 1)]) <= width) if len(h) else np.zeros(len(g), bool)
        while (more := inside(low - 1)).any():
            low = low - more
        while (less := (low < high) & ~inside(low)).any():
            low = low + less
        while (more := inside(high)).any():
            high = high + more
        while (less := (low < high) & ~inside(high - 1)).any():
            high = high - less
        met = np.flatnonzero(low < high)
        low, high = low[met], high[met]
        least = least_in_ranges(first, low, high)
        known = pa.array(least, mask=least == len(other))
        return pa.table({"key": key.take(pa.array(met)), "n": pa.array(upto[high] - upto[low]), "first": other.take(order.take(known))})

    return run


def band_counts(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, key: str, other: str) -> DataFrame:
    """(key, n, first): how many pairs of band_join() a key has, and the least ``other`` among them, without a row for a pair.

    A task sorts the right rows of a cell and its neighbours, or a part of
    them, and looks up the range of each of its left rows.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    cell = lambda c: F.floor(F.col(c) / (2 * width))  # noqa: E731  a difference that is rounded to the width is of neighbours
    asks = checkpoint(left.where(finite(left_value)).select(F.col(key).alias("key"), F.col(left_value).cast("double").alias("v"), cell(left_value).alias("cell")))
    held = checkpoint(right.where(finite(right_value)).select(F.col(other).alias("other"), F.col(right_value).cast("double").alias("v"), F.explode(F.array(*[cell(right_value) + k for k in (-1, 0, 1)])).alias("cell")))
    counts = lambda rows, most, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    dealt = checkpoint(counts(asks, LEFT_ROWS, "salts").join(counts(held, RIGHT_ROWS, "parts"), "cell"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_to = lambda n, own: F.pmod(F.xxhash64("v", own), F.col(n)).cast("int")
    asks = asks.join(dealt, "cell").withColumn("salt", dealt_to("salts", "key")).withColumn("part", spread("parts"))
    held = held.join(dealt, "cell").withColumn("part", dealt_to("parts", "other")).withColumn("salt", spread("salts"))
    group = ["cell", "part", "salt"]
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((left, key), (right, other))]
    met = asks.select(*group, "key", "v").groupBy(*group).cogroup(held.select(*group, "other", "v").groupBy(*group)).applyInArrow(_band(width), f"key {kinds[0]}, n bigint, first {kinds[1]}")
    return met.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _layers(events: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` layers of events that no denser one of the group reaches in length; all in one order."""
    before = Window.partitionBy(*by).orderBy(F.col("density").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("layer_", F.lit(None).cast("int"))
    for k in range(n):
        longest = F.max(F.when(F.col("layer_").isNull(), F.col("len"))).over(before)
        out = out.withColumn("longest_", longest)
        out = out.withColumn("layer_", F.when(F.col("layer_").isNull() & (F.col("longest_").isNull() | (F.col("len") > F.col("longest_"))), F.lit(k)).otherwise(F.col("layer_")))
    return out.where("layer_ IS NOT NULL").drop("layer_", "longest_")


def matching_events(cells: DataFrame, events: DataFrame, used: DataFrame, by: list[str], n: int = 1, salts: int = 64) -> DataFrame:
    """For each request the ``n`` densest unused events of its cell that are long enough.

    cells: (request_id, d, *by); events: (id, len, density, *by); used: (id).
    An event that ``n`` denser ones of its cell reach in length is nobody's
    choice.  Those others, a few for a cell's logarithm, are found in salted
    parts of the cell and then among the parts' survivors; only they are joined.
    """
    free = events.where(F.col("len").isNotNull()).join(used.select("id").distinct(), "id", "left_anti")
    parts = _layers(free.withColumn("salt_", F.pmod(F.xxhash64("id"), F.lit(salts))), [*by, "salt_"], n).drop("salt_")
    met = cells.join(_layers(parts, by, n), by).where(F.col("len") >= F.col("d"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("density").desc(), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n)


def picked_events(cells: DataFrame, events: DataFrame, used: DataFrame, by: list[str], n: int, seed: int = 42) -> DataFrame:
    """For each request one of its ``n`` densest matching events, by hash."""
    from .sampling import order_key

    met = matching_events(cells, events, used, by, n)
    pick = F.row_number().over(Window.partitionBy("request_id").orderBy(order_key("request_id", "id", seed=seed), "id"))
    return met.withColumn("pick_", pick).where("pick_ = 1").drop("pick_")


def aligned(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str) -> DataFrame:
    """Both values over the union of the keys, 0 where one is missing."""
    out = left.select(*keys, left_value).join(right.select(*keys, right_value), keys, "full")
    return out.select(*keys, F.coalesce(left_value, F.lit(0)).alias(left_value), F.coalesce(right_value, F.lit(0)).alias(right_value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column, eps: float = 1e-12) -> Column:
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(dot(wide, wide)) + eps
    return F.transform(wide, lambda x: x / norm)


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, value): the mean vector of each key, scaled to length 1; sums are partial before they shuffle."""
    each = vectors.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = each.groupBy(key).agg((F.sqrt(F.sum(F.col("mean") * F.col("mean"))) + 1e-12).alias("norm"))
    return each.join(norm, key).select(key, "dim", (F.col("mean") / F.col("norm")).alias("value"))


def prototypes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, embedding): centroids() as arrays."""
    at = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return centroids(vectors, key, vector).groupBy(key).agg(F.transform(at, lambda x: x["value"]).alias("embedding"))


def nearest_prototypes(items: DataFrame, item_id: str, vector: str, protos: DataFrame, name: str, k: int = 5, most: int = 10_000) -> DataFrame:
    """(item_id, name, similarity, rank) of the ``k`` most similar prototypes, by cosine.

    Prototypes are few by nature: up to ``most`` are one matrix, which travels
    with the tasks and is multiplied with blocks of items.  More are scanned in
    several such matrices, and their best are ranked together.  All vectors must
    have one dimension; items without a vector are left out; similarities count
    as equal up to 12 decimals, and then the smaller name is first.
    """
    n, low, high = protos.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        return items.select(item_id).join(protos.select(name), F.lit(False)).select(item_id, name, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    if low != high:
        raise ValueError(f"prototypes of {low} to {high} dimensions")
    if n > most:
        blocks = -(-n // most) * 2  # by hash, so some are fuller than others
        part = F.pmod(F.xxhash64(name), F.lit(blocks))
        each = functools.reduce(DataFrame.unionByName, [nearest_prototypes(items, item_id, vector, protos.where(part == b), name, k, n) for b in range(blocks)])
        rank = F.row_number().over(Window.partitionBy(item_id).orderBy(F.col("similarity").desc(), name))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)
    table = protos.select(F.col(name).alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).toArrow().sort_by("name")
    names, width = table.column("name").combine_chunks(), low or 0
    matrix = np.ascontiguousarray(table.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), width).T)
    wide = items.select(F.col(item_id).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ITEMS):
                batch = whole.slice(at, ITEMS)
                batch = batch.filter(batch.column(1).is_valid())
                sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != width).any():
                    raise ValueError(f"items of {int(sizes.min())} to {int(sizes.max())} dimensions beside prototypes of {width}")
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                # equal prototypes stay equal, whatever order they are added up in
                scores = np.round(v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12) @ matrix, 12)
                kept = min(k, len(names))
                least = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1:kept] if kept else scores
                row, col = np.nonzero(scores >= least) if kept else (np.zeros(0, np.int64),) * 2
                order = np.lexsort((col, -scores[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                use = rank < k
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[use])), names.take(pa.array(col[use])), pa.array(scores[row, col][use]), pa.array(rank[use] + 1, pa.int32())], names=["id", "name", "similarity", "rank"])

    id_kind, name_kind = (t.schema[c].dataType.simpleString() for t, c in ((items, item_id), (protos, name)))
    best = wide.mapInArrow(run, f"id {id_kind}, name {name_kind}, similarity double, rank int")
    return best.select(F.col("id").alias(item_id), F.col("name").alias(name), "similarity", "rank")
