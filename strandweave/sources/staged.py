"""What the writers of this package share: staged files, a committed list of them, and file systems by URI.

A task writes under names of its own in a staging folder; the driver moves
what the tasks of one job report, so a failed or repeated task leaves nothing
behind in the results.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//"))[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def new_name(folder: str, suffix: str = "") -> str:
    return f"{folder}/_staged-{uuid.uuid4().hex}{suffix}"


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task wrote, in order: (staged path, final name, rows, columns)."""

    files: list[tuple[str, str, int, int]]


def discard(messages: list[Staged | None]) -> None:
    for message in messages:
        for path, *_ in message.files if message else ():
            system, own = located(path)
            system.delete_file(own)
