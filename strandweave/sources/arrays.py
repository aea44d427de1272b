"""Sinks that write rows (out, line) to the files that they name: ``json_arrays`` as one array each, ``named_lines`` as lines.

Rows of a file must be consecutive and in order within a partition; a row
without a line only opens its file.  A task streams its files to staged ones,
which the driver moves to their names once all tasks are done.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.types import StructType

from . import staged
from .staged import Staged, discard, located, new_name


class NamedWriter(DataSourceArrowWriter):
    """Writes ``first``, the lines with ``between`` between them, and ``last``."""

    def __init__(self, first: bytes, between: bytes, last: bytes):
        self.first, self.between, self.last = first, between, last

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files: list[tuple[str, str, int, int]] = []
        out, stream, n = None, None, 0

        def close() -> None:
            if stream is not None:
                stream.write(self.last)
                stream.close()
                files[-1] = (*files[-1][:2], n, 1)

        try:
            for batch in iterator:
                for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name != out:
                        close()
                        out, n = name, 0
                        staged_name = new_name(name.rpartition("/")[0])
                        system, own = located(staged_name)
                        system.create_dir(own.rpartition("/")[0])
                        stream = system.open_output_stream(own)
                        files.append((staged_name, name, 0, 1))
                        stream.write(self.first)
                    if line is not None:
                        stream.write(self.between * (n > 0) + line.encode())
                        n += 1
            close()
        except Exception:
            if stream is not None:
                stream.close()
            discard([Staged(files)])
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            for path, name, *_ in message.files if message else ():
                system, own = located(path)
                system.move(own, located(name)[1])

    def abort(self, messages: list[Staged | None]) -> None:
        discard(messages)


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(b"[\n", b",\n", b"\n]")


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_lines"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(b"", b"\n", b"\n")


def register(spark: SparkSession) -> None:
    """Make the formats known; the classes travel with the tasks."""
    for module in (sys.modules[__name__], staged):
        cloudpickle.register_pickle_by_value(module)
    for source in (Arrays, Lines):
        spark.dataSource.register(source)
