"""Settings as a data source of versions: a write becomes visible as a whole, when its commit moves one pointer.

A job writes its rows into a folder of its own, then names the files of its successful attempts in the file CURRENT. Readers follow the pointer, so they meet the old
version or the new one and never a part; of two writers the later commit holds. An aborted job deletes its folder, and the
old version stays. A commit keeps the last KEEP versions for readers that have begun, and deletes older ones.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.operators.recipes import STATE

CURRENT, KEEP = "_current", 2


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def pointed(path: str) -> list[str]:
    """The files of the current version; none before the first."""
    from pyarrow import fs

    store, root = store_of(path)
    if store.get_file_info(posixpath.join(root, CURRENT)).type != fs.FileType.File:
        return []
    with store.open_input_stream(posixpath.join(root, CURRENT)) as f:
        return [posixpath.join(root, name) for name in json.loads(f.read())]


@dataclass
class Part(InputPartition):
    file: str


@dataclass
class Done(WriterCommitMessage):
    file: str


class SettingsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(f) for f in pointed(self.path)]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, _ = store_of(self.path)
        with store.open_input_stream(partition.file) as f:
            for line in f.read().decode().split("\n"):
                if line:
                    yield tuple(json.loads(line))


class SettingsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.version = path, f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> Done:
        store, root = store_of(self.path)
        file = posixpath.join(self.version, f"part-{uuid.uuid4().hex}")
        store.create_dir(posixpath.join(root, self.version))
        with store.open_output_stream(posixpath.join(root, file)) as out:
            for r in rows:
                out.write((json.dumps([r["name"], r["saved_ms"], r["state"]]) + "\n").encode())
        return Done(file)

    def commit(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        store.create_dir(posixpath.join(root, self.version))
        new = posixpath.join(root, f"{CURRENT}-{uuid.uuid4().hex}")
        with store.open_output_stream(new) as f:
            f.write(json.dumps([m.file for m in messages if m]).encode())
        store.move(new, posixpath.join(root, CURRENT))
        versions = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name.startswith("v-"))
        older = [v for v in versions if posixpath.basename(v) <= self.version]
        for v in older[:-KEEP]:
            store.delete_dir(v)

    def abort(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        if store.get_file_info(posixpath.join(root, self.version)).type == fs.FileType.Directory:
            store.delete_dir(posixpath.join(root, self.version))


class Settings(DataSource):
    """format("tessera_settings"): name, saved_ms and state, a JSON document."""

    @classmethod
    def name(cls) -> str:
        return "tessera_settings"

    def schema(self) -> str:
        return "name string, saved_ms bigint, state string"

    def reader(self, schema: StructType) -> SettingsReader:
        return SettingsReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SettingsWriter:
        return SettingsWriter(self.options["path"], overwrite)


def save_settings(df: DataFrame, path: str) -> None:
    """df(name, saved_ms, state as a JSON document) as the new version."""
    df.sparkSession.dataSource.register(Settings)
    df.select("name", "saved_ms", "state").write.format("tessera_settings").mode("overwrite").save(path)


def load_settings(spark: SparkSession, path: str) -> DataFrame:
    """name, saved_ms and state (see recipes.STATE) of the current version."""
    spark.dataSource.register(Settings)
    rows = spark.read.format("tessera_settings").load(path)
    return rows.select("name", "saved_ms", F.from_json("state", STATE).alias("state"))
