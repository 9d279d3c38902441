"""Image files: decoded to pixel relations by Spark's image source, and binary files written from a table by a data source of their own.

Reading plans its partitions as every file source does, on any store Spark can reach, and decodes in the JVM: PNG (also interlaced,
with palettes), JPEG (also progressive), GIF (the first frame), BMP and TIFF, to 8 bits. What cannot be decoded gives one row with an error
and no pixel, so that a broken file ends no job; a file without a byte gives no row. Pixels leave a task in bands; a task holds one image at a time, so an image must fit into it,
in pixels of at most four bytes.

Writing takes rows of name and content. A task writes its files into a folder of its own below one that readers skip, and only the
commit moves them to their place: a failed or repeated attempt leaves nothing behind, and an aborted job no file at all.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BAND = 1 << 16
PIXELS = "path string, width int, height int, x int, y int, r int, g int, b int, a int, error string"


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, width, height, channels, data (rows of pixels, blue first) of image files; width and data are null where decoding failed."""
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    sound = F.col("height") > 0
    return image.select(F.col("origin").alias("path"), *[F.when(sound, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))])


def pixels(images: DataFrame) -> DataFrame:
    """The PIXELS of read_images' rows: grey images have equal channels, those without transparency are opaque."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int32()) for c in PIXELS.split(", ")])

    def bands(path: str, width: int, height: int, channels: int, data: bytes) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(data, np.uint8).reshape(width * height, channels)
        order = (0, 0, 0) if channels == 1 else (2, 1, 0)
        for at in range(0, len(flat), BAND):
            part = flat[at : at + BAND].astype(np.int32)
            place, n = np.arange(at, at + len(part), dtype=np.int32), len(part)
            same = [pa.repeat(pa.scalar(v, t), n) for v, t in ((path, pa.string()), (width, pa.int32()), (height, pa.int32()))]
            alpha = part[:, 3] if channels == 4 else np.full(n, 255, np.int32)
            columns = [place % width, place // width, *[part[:, c] for c in order], alpha]
            yield pa.RecordBatch.from_arrays([*same, *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.nulls(n, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, width, height, channels, data = (b.column(c)[i].as_py() for c in range(5))
                if data is None:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": "not an image that can be decoded"}], schema=schema)
                else:
                    yield from bands(path, width, height, channels, data)

    return images.select("path", "width", "height", "channels", "data").mapInArrow(run, PIXELS)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, rows: Iterator) -> Written:
        store, root = self.store()
        folder, names = posixpath.join(root, self.job, uuid.uuid4().hex), []
        store.create_dir(folder)
        for row in rows:
            if not row["name"] or posixpath.basename(row["name"]) != row["name"] or row["name"].startswith(("_", ".")):
                raise ValueError(f"{row['name']!r} is no file name")
            with store.open_output_stream(posixpath.join(folder, row["name"])) as out:
                out.write(bytes(row["content"] or b""))
            names.append(row["name"])
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.store()
        from pyarrow import fs

        names = [n for m in messages if m for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two files of one name")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            for n in m.names if m else []:
                store.move(posixpath.join(m.folder, n), posixpath.join(root, n))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what is left of the job's own folder."""
        store, root = self.store()
        from pyarrow import fs

        if store.get_file_info(posixpath.join(root, self.job)).type == fs.FileType.Directory:
            store.delete_dir(posixpath.join(root, self.job))


class FilesSink(DataSource):
    """df(name, content).write.format("tessera_files").mode("append" or "overwrite").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Every row of df(name, content) as a file in the folder path."""
    df.sparkSession.dataSource.register(FilesSink)
    df.select("name", "content").write.format("tessera_files").mode("overwrite" if overwrite else "append").save(path)
