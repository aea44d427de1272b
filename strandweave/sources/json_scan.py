"""Structural scan of JSON documents of any size: their parts come out in parallel.

Spark's text reader cuts files at commas, in byte ranges, so no piece is longer
than a value, and a piece never begins after a backslash.

1. A pass sums up each byte range as a function: whether it holds an odd number
   of unescaped quotes, and, for either state of quotation before it, how it
   changes the depth of brackets and which bracket it opened last at each depth.
2. Windows over the ranges of a file compose these functions, so the state at
   which each range begins is known.
3. A second pass cuts every range into parts at the commas of the outer level:
   the elements of a list, the members of an object, and the elements of those
   members that are lists under given keys.  Parts that lie across ranges leave
   a fragment in each; a range leaves two at most, and they are put together by
   a grouping.

The file's structure is sound if brackets close as they should with nothing
after them; whether the parts are JSON is for the caller to see.  gzip files
are one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialise import checkpoint

BLANK = b" \t\r\n"
#: Byte ranges whose states may be broadcast; with more, pieces are dealt out by range.
MOST_RANGES = 200_000
_SUMMARY = "file string, block bigint, top string, odd boolean, outer bigint, inner bigint, outer_open map<bigint,string>, inner_open map<bigint,string>, seen bigint, bytes bigint"
_PART = "file string, top string, block bigint, nth bigint, edge int, opened boolean, closed boolean, key string, void boolean, problem boolean, ends bigint, text binary"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), "value")


def _joined(values: pa.Array) -> np.ndarray:
    """The pieces' bytes, each with its comma after it."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    edges = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    size = np.diff(edges)
    out = np.full(int((size + 1).sum()), 44, np.uint8)
    if data is not None:
        own = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]]
        out[np.arange(len(own)) + np.repeat(np.arange(len(size)), size)] = own
    return out


def _quotes(data: np.ndarray) -> np.ndarray:
    """True for quotes that no odd run of backslashes precedes."""
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != 92, at, -1))
    before = np.append(-1, other[:-1])
    return (data == 34) & ((at - 1 - before) % 2 == 0)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, from, to) of the rows of one range."""
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    new = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | np.array([a != b for a, b in zip(files, files[1:])], bool))) if len(files) else np.zeros(0, np.int64)
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(files)]):
        yield files[a], int(blocks[a]), a, b


def _key_before(data: np.ndarray, at: int, keys: re.Pattern) -> str:
    """The key in whose list the bracket at ``at`` opens, if it is one of those asked for, else ''."""
    if data[at] != 91:
        return ""
    commas = np.flatnonzero(data[max(0, at - 256):at] == 44)
    begin = max(0, at - 256) + (int(commas[-1]) + 1 if len(commas) else 0)
    found = keys.search(data[begin:at].tobytes())
    return found[1].decode() if found else ""


def _summaries(keys: tuple[str, ...]):
    named = _pattern(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def rows() -> pa.RecordBatch:
            columns = list(zip(*[(f, b, *x) for (f, b), x in held.items()], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.string()), pa.map_(pa.int64(), pa.string()), pa.int64(), pa.int64()), strict=True)], names=["file", "block", "top", "odd", "outer", "inner", "outer_open", "inner_open", "seen", "bytes"])

        for batch in batches:
            for file, block, a, b in _runs(batch):
                if held and (file, block) not in held:  # a task reads its ranges one after another
                    yield rows()
                    held.clear()
                state = held.setdefault((file, block), [None, False, 0, 0, [], [], 0, batch.column(2)[a].as_py()])
                data = _joined(batch.column(3).slice(a, b - a))
                if state[0] is None:
                    state[0] = chr(data[~np.isin(data, np.frombuffer(BLANK, np.uint8))][0])
                inside = np.cumsum(_quotes(data)) % 2 == 1
                opens, closes = (data == 91) | (data == 123), (data == 93) | (data == 125)
                # what is outside of strings, if the range begins outside (0) or inside of one (1)
                for way in (0, 1):
                    use = inside == (state[1] != bool(way))
                    change = np.where(use, opens.astype(np.int64) - closes, 0)
                    depth = state[2 + way] + np.cumsum(change)
                    at = np.flatnonzero(use & opens)
                    level, last = np.unique((depth[at] - 1)[::-1], return_index=True)
                    known = dict(state[4 + way])
                    known.update({int(v): _key_before(data, int(at[len(at) - 1 - k]), named) for v, k in zip(level, last, strict=True)})
                    state[4 + way] = list(known.items())
                    state[2 + way] = int(depth[-1])
                state[1] = state[1] != bool(inside[-1])
                state[6] += len(data)
        if held:
            yield rows()

    return run


def _pattern(keys: tuple[str, ...]) -> re.Pattern:
    return re.compile(rb'(?:^|[{,])\s*"(' + b"|".join(re.escape(k).encode() for k in keys) + rb')"\s*:\s*$' if keys else rb"(?!)()")


class _Cutter:
    """Cuts one byte range into parts, from the state at which it begins."""

    def __init__(self, file: str, block: int, top: str, inside: bool, depth: int, key: str, keys: re.Pattern):
        self.file, self.block, self.top, self.inside, self.depth, self.keys = file, block, top, inside, depth, keys
        self.key = key if depth >= 2 else ""
        self.head = depth >= 1
        self.pending: list[bytes] = []
        self.opened = self.after = self.problem = False
        self.nth = self.ends = 0
        self.rows: list[tuple] = []

    def part(self, text: bytes, closed: bool, key: str, void: bool = False) -> None:
        self.rows.append((self.file, self.top, self.block, self.nth, 1 if self.head else 0, self.opened and not self.head, closed, key, void, False, 0, text))
        self.nth += 1
        self.head = self.opened = False

    def take(self, data: np.ndarray) -> None:
        inside = (np.cumsum(_quotes(data)) % 2 == 1) != self.inside
        opens, closes = ~inside & ((data == 91) | (data == 123)), ~inside & ((data == 93) | (data == 125))
        commas = ~inside & (data == 44)
        depth = self.depth + np.cumsum(opens.astype(np.int64) - closes)
        outer = 2 if self.top == "{" else 1
        events = np.flatnonzero((opens & (depth <= outer)) | (closes & (depth < outer)) | (commas & (depth <= outer)))
        begin = 0

        def text(to: int) -> bytes:
            out = b"".join([*self.pending, data[begin:to].tobytes()])
            self.pending.clear()
            return out

        for i, c, d in zip(events.tolist(), data[events].tolist(), depth[events].tolist(), strict=True):
            if c in (91, 123):
                if d == 1:
                    self.problem |= bool(text(i).strip(BLANK)) or self.ends > 0 or self.nth > 0
                    begin, self.opened = i + 1, True
                elif d == 2:
                    so_far = b"".join([*self.pending, data[begin:i].tobytes()])
                    found = self.keys.search(so_far) if c == 91 and not self.key and len(so_far) < 512 else None
                    if found:
                        if self.head:  # the part begins where the range before ended
                            self.part(b"", False, "", void=True)
                        text(i)
                        begin, self.key, self.opened = i + 1, found[1].decode(), True
                else:
                    self.problem = True
            elif c in (93, 125):
                if d == 0:
                    rest = text(i)
                    begin = i + 1
                    if self.after:
                        self.problem |= bool(rest.strip(BLANK))
                        self.after = False
                    else:
                        self.part(rest, True, "")
                    self.problem |= c != (125 if self.top == "{" else 93)
                elif d == 1 and self.key:
                    self.part(text(i), True, self.key)
                    self.problem |= c != 93
                    begin, self.key, self.after = i + 1, "", True
                elif d < 0:
                    self.problem = True
            elif d == 1:
                rest = text(i)
                begin = i + 1
                if self.after:
                    self.problem |= bool(rest.strip(BLANK))
                    self.after = False
                else:
                    self.part(rest, False, "")
            elif d == 2 and self.key:
                self.part(text(i), False, self.key)
                begin = i + 1
            elif d <= 0:
                self.problem |= bool(text(i).strip(BLANK))
                begin, self.ends = i + 1, self.ends + 1
        self.pending.append(data[begin:].tobytes())
        self.inside, self.depth = bool(inside[-1]), int(depth[-1])

    def close(self) -> None:
        """The range ends: what is left is the beginning of a part, or all of the range is within one."""
        rest = b"".join(self.pending)
        if self.depth >= 1:
            self.rows.append((self.file, self.top, self.block, self.nth, 3 if self.head else 2, self.opened and not self.head, False, self.key, False, False, 0, rest))
        else:
            self.problem |= bool(rest.strip(BLANK))
        self.rows.append((self.file, self.top, self.block, -1, -1, False, False, "", False, self.problem, self.ends, b""))


def parts(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(parts, files) of the documents of a path.

    parts: (file, top, key, block, nth, opened, closed, text): elements of a
    top-level list (top "[") or members ``"name": value`` of a top-level object
    (top "{"), with key '' ; members that are lists under one of ``keys`` come as
    their elements, with that key.  opened and closed: nothing stands between
    the part and the bracket that opens or closes its container, so the one part
    of an empty container is blank and both.  (file, block, nth) is their order.
    files: (file, top, sound).
    """
    found = _pieces(spark, path).mapInArrow(_summaries(keys), _SUMMARY)
    sums = checkpoint(found)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = sums.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    state = state.withColumn("change", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    opened = F.when(F.col("inside"), F.col("inner_open")).otherwise(F.col("outer_open"))
    state = state.withColumn("last_key", F.element_at(opened, 1 - F.col("depth"))).withColumn("key", F.coalesce(F.last("last_key", True).over(before), F.lit("")))
    state = checkpoint(state.withColumn("top", F.first("top", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select("file", "block", "top", "inside", "depth", "key", "change", "odd", "seen", "bytes"))
    files = state.groupBy("file").agg(F.first("top").alias("top"), F.sum("change").alias("last_depth"), (F.sum(F.col("odd").cast("int")) % 2 == 1).alias("last_inside"), (F.sum("seen") == F.max("bytes")).alias("comma_last"))
    known = state.where("top IN ('[', '{')").select("file", "block", "top", "inside", "depth", "key")
    pieces = _pieces(spark, path)
    if state.count() <= MOST_RANGES:
        stated = pieces.join(F.broadcast(known), ["file", "block"])
    else:
        stated = pieces.withColumn("k", F.monotonically_increasing_id()).join(known, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "k")
    stated = stated.select("file", "block", "bytes", "value", "top", "inside", "depth", "key")
    named = _pattern(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*cutter.rows, strict=True)) or [[]] * 12
            cutter.rows = []
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "top", "block", "nth", "edge", "opened", "closed", "key", "void", "problem", "ends", "text"])

        for batch in batches:
            for file, block, a, b in _runs(batch):
                if cutter is None or (cutter.file, cutter.block) != (file, block):
                    if cutter is not None:
                        cutter.close()
                        yield rows()
                    top, inside, depth, key = (batch.column(c)[a].as_py() for c in (4, 5, 6, 7))
                    cutter = _Cutter(file, block, top, inside, depth, key, named)
                cutter.take(_joined(batch.column(3).slice(a, b - a)))
                yield rows()
        if cutter is not None:
            cutter.close()
            yield rows()

    cut = checkpoint(stated.mapInArrow(run, _PART))
    # fragments: one that opens a part, those of ranges within it, and the one that ends it
    edges = cut.where("edge > 0").withColumn("own", F.when(F.col("edge") == 2, F.col("block")))
    edges = edges.withColumn("of", F.when(F.col("edge") == 2, F.col("block")).otherwise(F.last("own", True).over(Window.partitionBy("file").orderBy("block", F.col("edge") == 2).rowsBetween(Window.unboundedPreceding, -1))))
    fragment = F.struct("block", "nth", "edge", "closed", "key", "void", "text")
    whole = edges.groupBy("file", "of").agg(F.sort_array(F.collect_list(fragment)).alias("all"), F.max("opened").alias("opened"), F.first("top").alias("top")).withColumn("end", F.element_at("all", -1))
    texts = F.array_join(F.transform("all", lambda x: x["text"].cast("string")), "")
    ended = checkpoint(whole.where("end.edge = 1").select("file", "top", F.col("end.key").alias("key"), F.col("end.block").alias("block"), F.col("end.nth").alias("nth"), "opened", F.col("end.closed").alias("closed"), texts.alias("text"), F.col("end.void").alias("void")))
    plain = cut.where("edge = 0").select("file", "top", "key", "block", "nth", "opened", "closed", F.col("text").cast("string").alias("text"))
    bad = ended.where(F.col("void") & F.col("text").rlike(r"[^ \t\r\n]")).select("file").distinct().withColumn("odd_key", F.lit(True))
    facts = cut.where("edge = -1").groupBy("file").agg(F.max("problem").alias("problem"), F.sum("ends").alias("ends"))
    # one comma stands after the document, the reader's own
    sound = (F.col("last_depth") == 0) & ~F.col("last_inside") & ~F.col("problem") & (F.col("ends") == 1) & F.col("odd_key").isNull() & (~F.col("comma_last") | F.col("file").endswith(".gz"))
    checked = files.join(facts, "file", "left").join(bad, "file", "left").select("file", "top", F.coalesce(sound, F.lit(False)).alias("sound"))
    return plain.unionByName(ended.where("NOT void").drop("void")), checkpoint(checked)
