"""Several tables that change together: staged writes and one manifest that readers follow.

Tables live under one root.  A batch writes each table's new rows to a folder
of its own; then one small file with the whole new state is added to the
manifest, and only with it do the folders count.  A batch that fails before
that changes no table, a batch whose name is committed is not written again,
and readers see all tables of a batch or none.  One writer at a time; readers
are free.

The state has one entry for each live folder, so it grows with the number of
batches, not of rows; vacuum() removes folders that no state counts, and old
states.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staged import located


@dataclass
class State:
    version: int = 0
    #: table: its folders, each with its facts
    folders: dict[str, list[dict]] = field(default_factory=dict)
    #: writer: its last batch
    done: dict[str, int] = field(default_factory=dict)
    facts: dict[str, int] = field(default_factory=dict)


class Batches:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> State:
        try:
            states = self.spark.read.schema("version bigint, state string").json(f"{self.root}/_manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return State()
        last = states.agg(F.max_by("state", "version").alias("state")).first()
        return State(**json.loads(last["state"])) if last and last["state"] else State()

    def commit(self, new: dict[str, DataFrame], writer: str | None = None, batch: int | None = None, replaced: dict[str, list[str]] | None = None, facts: dict[str, int] | None = None, partition: dict[str, str] | None = None, about: dict[str, dict] | None = None) -> bool:
        """Add the frames' rows to their tables, in one step; False if ``writer`` has committed ``batch`` before.

        replaced: folders of a table that no longer count; facts: numbers to keep
        with the state; partition: a table's column that its folder is divided
        by; about: what to note beside a table's new folder.
        """
        state = self.state()
        if writer is not None and state.done.get(writer, -1) >= batch:
            return False
        for name, gone in (replaced or {}).items():
            state.folders[name] = [x for x in state.folders.get(name, []) if x["path"] not in gone]
        for name, rows in new.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            write = rows.write.partitionBy(partition[name]) if partition and name in partition else rows.write
            write.parquet(path)
            state.folders.setdefault(name, []).append({"path": path, "schema": rows.schema.json(), "divided": bool(partition and name in partition), **(about or {}).get(name, {})})
        if writer is not None:
            state.done[writer] = batch
        state.facts.update(facts or {})
        state.version += 1
        row = (state.version, json.dumps(vars(state)))
        self.spark.createDataFrame([row], "version bigint, state string").coalesce(1).write.mode("append").json(f"{self.root}/_manifest")
        return True

    def read(self, name: str, schema: str | None = None, where: Column | None = None, folders: list[dict] | None = None) -> DataFrame:
        """The rows of a table; an unknown one has none, of the given schema."""
        found = self.state().folders.get(name, []) if folders is None else folders
        if not found:
            if schema is None:
                raise ValueError(f"no table {name} under {self.root}")
            return self.spark.createDataFrame([], schema)
        groups: dict[tuple, list[str]] = {}
        for x in found:  # divided folders are read one by one
            groups.setdefault((x["schema"], x["path"] if x["divided"] else ""), []).append(x["path"])
        parts = [self.spark.read.schema(StructType.fromJson(json.loads(text))).parquet(*paths) for (text, _), paths in groups.items()]
        return functools.reduce(DataFrame.unionByName, [p if where is None else p.where(where) for p in parts])

    def vacuum(self) -> list[str]:
        """Delete folders and states that no longer count, while nobody writes; their paths."""
        state, gone = self.state(), []
        live = {x["path"].rpartition("/")[2] for found in state.folders.values() for x in found}
        system, root = located(self.root)
        for table in system.get_file_info(fs.FileSelector(root)):
            if table.type != fs.FileType.Directory or table.base_name == "_manifest":
                continue
            for folder in system.get_file_info(fs.FileSelector(table.path)):
                if folder.base_name not in live:
                    system.delete_dir(folder.path)
                    gone.append(folder.path)
        states = self.spark.read.schema("version bigint, state string").json(f"{self.root}/_manifest")
        for row in states.where(F.col("version") < state.version).select(F.col("_metadata.file_path").alias("file")).distinct().toLocalIterator():
            own, path = located(row.file)
            own.delete_file(path)
            gone.append(path)
        return gone


def append_catalog(batches: Batches, candidates: DataFrame, order: list[str], templates: str = "templates", writer: str | None = None, batch: int | None = None) -> bool:
    """Add candidates and the links to their templates, together or not at all.

    Ids are running numbers in ``order`` that go on where the batch before
    ended; ``templates`` is an array of names, a link (candidate_id,
    template_name) each.
    """
    from ..operators.materialise import checkpoint
    from ..operators.windows import numbered

    next_id = batches.state().facts.get("next_id", 1)
    rows = checkpoint(numbered(candidates, order, "id").withColumn("id", F.col("id") + F.lit(next_id)))
    last = rows.agg(F.max("id")).first()[0] or next_id - 1
    links = rows.select(F.col("id").alias("candidate_id"), F.explode(templates).alias("template_name"))
    return batches.commit({"candidates": rows.drop(templates), "templates": links}, writer, batch, facts={"next_id": last + 1})
