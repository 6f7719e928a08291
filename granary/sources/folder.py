"""Files as a data source: ``spark.read.format("granary_files").load(folder)`` gives items.

Tasks open their own files, one at a time, and hand items on in batches of bounded size. A file
that is gone, too large or not readable is a row with its error, so one bad file costs no job.
For the data source the driver lists names and sizes and deals them into parts of some bytes
each. ``read`` and ``contents`` list in tasks, a folder in each, and deal the list by Spark:
only names of folders reach the driver, so they are for folders of very many files.

Options: ``extensions`` (those to read, by commas; all where unset), ``part_bytes`` (of a
part at most, 64 MB), ``parts`` (that many at least, where there are bytes for them), and
``max_bytes`` (of a file, 256 MB; a larger one is an error row).
"""

from __future__ import annotations

import hashlib
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from granary.sources.files import read_file
from granary.sources.vault import checkpoint

FORMAT = "granary_files"
SCHEMA = "path string, title string, kind string, content string, error string, bytes_hash string, hash string, size long, added_at long"
ARROW = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in (f.split() for f in SCHEMA.split(", "))])
LISTED = "path string, size long, seconds long, folder boolean"
CONTENTS = "path string, seconds long, length long, content binary"
#: Rows of a list that a task hands on at once, and files of a part at most.
LISTED_ROWS, PART_FILES = 10_000, 16_384
PART_BYTES, LEAST_BYTES, MAX_BYTES, BATCH_BYTES = 64 << 20, 1 << 18, 256 << 20, 8 << 20


@dataclass
class Part(InputPartition):
    """The files of a task: (path, size, seconds)."""

    files: list[tuple[str, int, int]]


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.extensions = {e.strip().lower().lstrip(".") for e in options.get("extensions", "").split(",")} - {""}
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.parts = int(options.get("parts", 1))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))

    def store(self):
        """The file system and the path of the folder within it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[str, int, int]]:
        """Files below the folder by path; names that begin with a dot or an underscore, and what lies in such folders, are left out."""
        from pyarrow import fs

        store, root = self.store()
        if store.get_file_info(root).type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} is not there")
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            inner = posixpath.relpath(info.path, root).split("/")
            wanted = not self.extensions or info.extension.lower() in self.extensions
            if info.type == fs.FileType.File and wanted and not any(n[0] in "._" for n in inner):
                found.append((info.path, info.size, int(info.mtime.timestamp()) if info.mtime else 0))
        return sorted(found)

    def entries(self, path: str) -> Iterator[tuple[str, int, int, bool]]:
        """What lies in one folder and is wanted: (path, size, seconds, whether it is a folder)."""
        from pyarrow import fs

        store, _ = self.store()
        if isinstance(store, fs.LocalFileSystem):  # one at a time, however many there are
            with os.scandir(path) as there:
                for e in there:
                    inner = e.is_dir(follow_symlinks=False)
                    if e.name[0] not in "._" and (inner or e.is_file() and self.wanted(e.name)):
                        try:
                            info = e.stat()
                        except FileNotFoundError:
                            continue
                        yield f"{path}/{e.name}", info.st_size, int(info.st_mtime), inner
            return
        for info in store.get_file_info(fs.FileSelector(path)):
            inner = info.type == fs.FileType.Directory
            if info.base_name[0] not in "._" and (inner or info.type == fs.FileType.File and self.wanted(info.base_name)):
                yield info.path, info.size or 0, int(info.mtime.timestamp()) if info.mtime else 0, inner

    def wanted(self, name: str) -> bool:
        return not self.extensions or posixpath.splitext(name)[1][1:].lower() in self.extensions

    def dealt(self, spark: SparkSession) -> DataFrame:
        """Rows (path, size, seconds) of the files below the folder, listed by tasks and dealt into parts."""
        from pyarrow import fs

        store, root = self.store()
        if store.get_file_info(root).type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} is not there")
        entries = self.entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    rows: list[tuple] = []
                    for row in entries(path):
                        rows.append(row)
                        if len(rows) == LISTED_ROWS:
                            yield typed(rows, LISTED)
                            rows = []
                    yield typed(rows, LISTED)

        found, folders = [], [root]
        while folders:
            each = spark.sparkContext.parallelize([(f,) for f in folders], min(len(folders), 4 * spark.sparkContext.defaultParallelism))
            level = checkpoint(spark.createDataFrame(each, "path string").mapInArrow(run, LISTED))
            found.append(level.where("not folder").drop("folder"))
            folders = [r.path for r in level.where("folder").select("path").collect()]
        files = found[0]
        for more in found[1:]:
            files = files.unionByName(more)
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        most = min(self.part_bytes, max(LEAST_BYTES, size // self.parts))
        return files.repartition(max(1, -(-size // most), -(-n // PART_FILES)))

    def items(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow: the items of listed files."""
        for b in batches:
            yield from self.read(Part(list(zip(*(b.column(c).to_pylist() for c in ("path", "size", "seconds")), strict=True))))

    def partitions(self) -> list[Part]:
        files = self.listed()
        most = min(self.part_bytes, max(LEAST_BYTES, sum(f[1] for f in files) // self.parts))
        parts, room = [], 0
        for file in files:
            if not parts or file[1] > room:
                parts.append(Part([]))
                room = most
            parts[-1].files.append(file)
            room -= file[1]
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = self.store()
        rows, held = [], 0
        for path, size, seconds in partition.files:
            rows.append(self.item(store, path, size, seconds))
            held += len(rows[-1][3] or "")
            if held > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    def item(self, store, path: str, size: int, seconds: int) -> tuple:
        name = path.rpartition("/")[2]
        if size > self.max_bytes:
            return path, name, None, None, f"{name}: {size} bytes are more than {self.max_bytes}", None, None, size, seconds
        try:
            with store.open_input_stream(path) as file:
                data = file.read()
        except OSError as e:
            return path, name, None, None, f"{name}: {e}", None, None, size, seconds
        title, kind, content, error = read_file(name, data)
        digest = hashlib.sha256(data).hexdigest()
        item = None if kind is None else hashlib.sha256(f"{kind}\0{digest}".encode()).hexdigest()
        return path, title, kind, content, error, digest, item, size, seconds


def batch(rows: list[tuple]) -> pa.RecordBatch:
    clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v
    return pa.RecordBatch.from_arrays([pa.array([clean(r[k]) for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def typed(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _reader(spark: SparkSession, path: str, options: dict) -> FolderReader:
    return FolderReader({"parts": spark.sparkContext.defaultParallelism} | options | {"path": path})


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Items of the files below a folder, with the options of the data source."""
    reader = _reader(spark, path, options)
    return reader.dealt(spark).mapInArrow(reader.items, SCHEMA)


def contents(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Rows (path, modificationTime, length, content) of the files below a folder, as ``binaryFile`` has them; one that is gone by then is left out."""
    reader = _reader(spark, path, options)
    before = "file:" if "://" not in path and not path.startswith("file:") else path[: path.rstrip("/").rindex(reader.store()[1].rstrip("/"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = reader.store()
        for b in batches:
            rows, held = [], 0
            for path, seconds in zip(b.column("path").to_pylist(), b.column("seconds").to_pylist(), strict=True):
                try:
                    with store.open_input_stream(path) as file:
                        data = file.read()
                except FileNotFoundError:
                    continue
                rows.append((before + path, seconds, len(data), data))
                held += len(data)
                if held > BATCH_BYTES:
                    yield typed(rows, CONTENTS)
                    rows, held = [], 0
            if rows:
                yield typed(rows, CONTENTS)

    found = reader.dealt(spark).mapInArrow(run, CONTENTS)
    return found.select("path", F.timestamp_seconds("seconds").alias("modificationTime"), "length", "content")
