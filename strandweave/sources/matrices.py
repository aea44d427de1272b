"""Matrices in .npy files as a data source, by row blocks.

``spark.read.format("npy").load(path)`` gives (row bigint, vector array<float|double>)
of a file, or of a folder's .npy files in order of their names, rows numbered
through.  The driver reads headers alone; a task reads the byte range of its
rows.  ``df.write.format("npy").save(path)`` writes the column ``vector`` in the
frame's order: with option ``single`` one file, else a folder of them.

Options: ``width``: the number of columns that a matrix must have; ``block``:
bytes of rows that a task reads, or that a file of a folder has at most.
Matrices are of two dimensions, of numbers, and stored by rows; other files
raise, and so do rows of unequal lengths or without values.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import staged
from .staged import Staged, discard, located, new_name

BLOCK_BYTES, COPY_BYTES = 64 << 20, 8 << 20


@dataclass
class Header:
    """Where a file's rows begin, how many there are, and of what."""

    path: str
    rows: int
    width: int
    kind: np.dtype
    offset: int


def read_header(path: str, width: int | None = None) -> Header:
    system, own = located(path)
    with system.open_input_file(own) as file:
        version = np.lib.format.read_magic(file)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: version {version} of the format is not read")
        shape, by_columns, kind = read(file)
        if len(shape) != 2 or kind.kind not in "fiu" or (by_columns and min(shape) > 1):
            raise ValueError(f"{path}: not a matrix of numbers stored by rows: shape {shape}, {kind}")
        if width is not None and shape[1] != width:
            raise ValueError(f"{path}: {shape[1]} columns instead of {width}")
        return Header(path, *shape, kind, file.tell())


def files_of(path: str) -> list[str]:
    system, own = located(path)
    if system.get_file_info(own).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(own))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name) if x.base_name.endswith(".npy") and not x.base_name.startswith("_")]


@dataclass
class RowBlock(InputPartition):
    header: Header
    first: int
    rows: int
    number: int  # of the first row in the whole


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, width: int | None, block: int, single_precision: bool):
        self.path, self.width, self.block, self.single_precision = path, width, block, single_precision

    def partitions(self) -> list[RowBlock]:
        out, number = [], 0
        for path in files_of(self.path):
            header = read_header(path, self.width)
            step = max(1, self.block // max(1, header.width * header.kind.itemsize))
            out += [RowBlock(header, at, min(step, header.rows - at), number + at) for at in range(0, header.rows, step)]
            number += header.rows
        return out

    def read(self, partition: RowBlock) -> Iterator[pa.RecordBatch]:
        own = partition.header
        size = max(1, own.width * own.kind.itemsize)
        kind = np.float32 if self.single_precision else np.float64
        system, path = located(own.path)
        with system.open_input_file(path) as file:
            step = max(1, COPY_BYTES // size)
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                data = file.read_at(n * size, own.offset + (partition.first + at) * size)
                values = np.frombuffer(data, own.kind).astype(kind)
                if len(values) != n * own.width:
                    raise ValueError(f"{own.path}: shorter than its header says")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * own.width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.number + at), vectors], names=["row", "vector"])


def header_bytes(rows: int, width: int, kind: np.dtype) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (rows, width)})
    return out.getvalue()


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, single: bool, block: int):
        kinds = {"array<float>": np.dtype("<f4"), "array<double>": np.dtype("<f8")}
        found = {f.name: f.dataType.simpleString() for f in schema.fields}
        if found.get("vector") not in kinds:
            raise ValueError("a column vector of type array<float> or array<double> is needed")
        self.path, self.overwrite, self.single, self.block, self.kind = path.rstrip("/"), overwrite, single, block, kinds[found["vector"]]
        self.column = list(found).index("vector")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, parent = located(self.path.rpartition("/")[0])
        system.create_dir(parent)
        task = TaskContext.get().partitionId()
        files, held, rows, width = [], [], 0, None

        def flush() -> None:
            nonlocal rows
            if rows:
                name = new_name(self.path.rpartition("/")[0], ".npy")
                system_, own = located(name)
                with system_.open_output_stream(own) as out:
                    out.write(header_bytes(rows, width, self.kind))
                    for x in held:
                        out.write(x)
                files.append((name, f"part-{task:05}-{len(files):05}.npy", rows, width))
            held.clear()
            rows = 0

        try:
            for batch in iterator:
                vectors = batch.column(self.column)
                lengths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False)) if not vectors.null_count else [None]
                if len(lengths) > 1 or (width is not None and len(lengths) and lengths[0] != width) or vectors.null_count or vectors.flatten().null_count:
                    raise ValueError("rows of a matrix must have one length and no nulls")
                width = int(lengths[0]) if len(lengths) else width
                held.append(vectors.flatten().to_numpy().astype(self.kind).tobytes())
                rows += batch.num_rows
                if sum(map(len, held)) >= self.block:
                    flush()
            flush()
        except Exception:
            discard([Staged(files)])
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        files.sort(key=lambda x: x[1])
        if len({x[3] for x in files}) > 1:
            discard(messages)
            raise ValueError(f"rows of unequal lengths: {sorted({x[3] for x in files})}")
        system, target = located(self.path)
        there = system.get_file_info(target).type
        if there != fs.FileType.NotFound and not self.overwrite:
            discard(messages)
            raise FileExistsError(self.path)
        final = new_name(self.path.rpartition("/")[0])
        _, own = located(final)
        if self.single:
            with system.open_output_stream(own) as out:
                out.write(header_bytes(sum(x[2] for x in files), files[0][3] if files else 0, self.kind))
                for path, _, rows, width in files:
                    with system.open_input_file(located(path)[1]) as part:
                        part.seek(len(header_bytes(rows, width, self.kind)))
                        while data := part.read(COPY_BYTES):
                            out.write(data)
            discard(messages)
        else:
            system.create_dir(own)
            for path, name, *_ in files:
                system.move(located(path)[1], f"{own}/{name}")
        if there == fs.FileType.Directory:
            system.delete_dir(target)
        elif there == fs.FileType.File:
            system.delete_file(target)
        system.move(own, target)

    def abort(self, messages: list[Staged | None]) -> None:
        discard(messages)


class Matrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def _single_precision(self) -> bool:
        files = files_of(self.options["path"])
        return bool(files) and read_header(files[0]).kind in (np.float16, np.float32)

    def schema(self) -> str:
        return f"row bigint, vector array<{'float' if self._single_precision() else 'double'}>"

    def reader(self, schema: StructType) -> MatrixReader:
        width = self.options.get("width")
        return MatrixReader(self.options["path"], None if width is None else int(width), int(self.options.get("block", BLOCK_BYTES)), "float" in schema["vector"].dataType.simpleString())

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], schema, overwrite, self.options.get("single", "false").lower() == "true", int(self.options.get("block", BLOCK_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known; the classes travel with the tasks."""
    for module in (sys.modules[__name__], staged):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(Matrices)


def read_matrix(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("npy")
    return (reader if width is None else reader.option("width", width)).load(path)


def write_matrix(vectors: DataFrame, path: str, key: str, vector: str = "vector", single: bool = True, mode: str = "overwrite") -> None:
    """The vectors in order of ``key`` as ``path``, and their keys, in that order, as JSON lines (row, key) in ``path`` + ".keys"."""
    from ..operators.windows import numbered

    register(vectors.sparkSession)
    ordered = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).orderBy("key")
    ordered.select("vector").write.format("npy").mode(mode).option("single", str(single).lower()).save(path)
    numbered(vectors.select(F.col(key).alias("key")), ["key"], "row").write.mode(mode).json(f"{path}.keys")


def read_keyed(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(key, vector) of what write_matrix() wrote; a number of keys other than that of rows raises."""
    vectors = read_matrix(spark, path, width)
    keys = spark.read.json(f"{path}.keys")
    joined = keys.join(vectors, "row", "full_outer")
    lost = F.raise_error(F.lit("keys and rows of the matrix differ in number"))
    return joined.select(F.when(F.col("vector").isNull() | F.col("key").isNull(), lost.cast("string")).otherwise(F.col("key")).alias("key"), "vector")
