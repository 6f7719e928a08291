"""A sink of files: rows (name, content) become files of a folder, all of a write or none.

Each task writes its files into a staging folder of its own, with a list of their names; once
all tasks are done the files are moved into place by tasks too, and where one failed they are
removed. No list of files reaches the driver. Names are unique in the folder: of rows
of one name one is written, and a file that is there stays, so that a write may be run
again. Kept copies are named by the hash of their bytes, so equal bytes are one copy.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "granary_copies"
SCHEMA = "name string, content binary"
#: The file that lists names: of a task's files, by line, or of the tasks' folders.
NAMES = "names"


@dataclass
class Staged(WriterCommitMessage):
    """The folder in which a task staged its files and their names."""

    folder: str


class Copies(DataSource):
    """The data source behind ``write``: option path is a folder of any file system that pyarrow knows by its address.

    With option staging, a name, files stay in that folder, and ``moved`` moves them; else the driver does.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("copies are only ever added")
        return CopiesWriter(self.options["path"], self.options.get("staging"))


class CopiesWriter(DataSourceWriter):
    def __init__(self, path: str, staging: str | None = None):
        self.path, self.later = path, staging is not None
        self.staging = staging or f"_staging-{uuid.uuid4().hex}"

    def folder(self):
        """The file system and the path of the folder within it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = self.folder()
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(own)
        with store.open_output_stream(f"{own}/{NAMES}") as names:
            for n, row in enumerate(iterator):
                if ".." in row.name.split("/") or row.name.startswith("/"):
                    raise ValueError(f"{row.name} is not in the folder")
                with store.open_output_stream(f"{own}/{n}") as out:
                    out.write(row.content or b"")
                names.write(json.dumps(row.name).encode() + b"\n")
        return Staged(own)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self.folder()
        done = [m.folder for m in messages if m]
        if self.later:
            store.create_dir(f"{root}/{self.staging}")
            with store.open_output_stream(f"{root}/{self.staging}/{NAMES}") as out:
                out.write(json.dumps(done).encode())
            return
        for own in done:
            self.place(own)
        self.clear(store, root)

    def place(self, own: str) -> int:
        """Moves what a task staged; a file that is there stays, and one that was moved before is not missed."""
        from pyarrow import fs

        store, root = self.folder()
        made, n = set(), -1
        with store.open_input_stream(f"{own}/{NAMES}") as names:
            for n, line in enumerate(io.BufferedReader(names)):
                to = f"{root}/{json.loads(line)}"
                parent = to.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent)
                    made.add(parent)
                if store.get_file_info(to).type == fs.FileType.NotFound:
                    store.move(f"{own}/{n}", to)
        return n + 1

    def moved(self, spark: SparkSession) -> None:
        """Moves what all tasks staged, in tasks, and removes the rest."""
        store, root = self.folder()
        with store.open_input_stream(f"{root}/{self.staging}/{NAMES}") as done:
            folders = json.loads(done.read())
        place = self.place

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([place(f) for f in batch.column(0).to_pylist()], pa.int64())], ["files"])

        if folders:
            each = spark.sparkContext.parallelize([(f,) for f in folders], len(folders))
            spark.createDataFrame(each, "folder string").mapInArrow(run, "files long").agg(F.sum("files")).collect()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear(*self.folder())

    def clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


def write(files: DataFrame, path: str) -> None:
    """Writes rows (name, content) as files of a folder. Of rows of one name the one of the least content stays; null names are left out, null contents are empty."""
    files.sparkSession.dataSource.register(Copies)
    one = files.where("name is not null").groupBy("name").agg(F.min("content").alias("content"))
    writer = CopiesWriter(path, f"_staging-{uuid.uuid4().hex}")
    try:
        one.write.format(FORMAT).option("path", path).option("staging", writer.staging).mode("append").save()
        writer.moved(files.sparkSession)
    finally:
        writer.abort([])


def keep(kept: DataFrame, path: str) -> DataFrame:
    """Writes the copies (path, stored, content) that ``kept_copies`` chose, and gives where each item's copy is (path, stored)."""
    write(kept.select(F.col("stored").alias("name"), "content"), path)
    return kept.select("path", "stored")
