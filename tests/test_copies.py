"""The sink of files: whole or not at all, twice the same, one copy for equal bytes."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.sources import copies, files


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_copies_are_kept_once(spark, tmp_path):
    rows = [(f"/in/{i}.{'PDF' if i % 2 else 'txt'}", f"bytes {i % 5}".encode()) for i in range(40)] + [("/in/none.txt", b""), ("/in/huge.txt", b"x" * 3000)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    kept = files.kept_copies(df, "always")
    folder = tmp_path / "vault"
    where = {r.path: r.stored for r in copies.keep(kept, str(folder)).collect()}
    first = tree(folder)
    assert {p: first[s] for p, s in where.items()} == dict(rows)
    assert len(first) == 12  # five texts under two extensions, and two more
    copies.keep(kept, f"file://{folder}")
    assert tree(folder) == first
    assert files.kept_copies(df, "never").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "vault"
    good = spark.createDataFrame([("a/x.txt", b"one"), ("a/y.txt", None), (None, b"no name")], "name string, content binary")
    copies.write(good, str(folder))
    before = tree(folder)
    assert before == {"a/x.txt": b"one", "a/y.txt": b""}
    rows = [(f"b/{i}.txt", b"new") for i in range(30)] + [("../out.txt", b"bad")]
    with pytest.raises(Exception, match="not in the folder"):
        copies.write(spark.createDataFrame(rows, "name string, content binary").repartition(4), str(folder))
    assert tree(folder) == before and not list(Path(folder).glob("_staging*"))
    copies.write(spark.createDataFrame([("a/x.txt", b"other"), ("c.txt", b"2"), ("c.txt", b"1")], "name string, content binary"), str(folder))
    assert tree(folder) == before | {"c.txt": b"1"}
    copies.write(good.limit(0), str(folder))
    assert tree(folder) == before | {"c.txt": b"1"}


def test_files_come_back_as_items(spark, tmp_path):
    rows = [("notes/a.md", "# Title\n\nbody".encode()), ("b.bin", b"\x00\x01"), ("c.url", b"[InternetShortcut]\nURL=https://example.org/x\n"), ("d.txt", " ".encode()), ("e.url", b"nothing")]
    copies.write(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "in"))
    got = {r.title: (r.kind, r.content, r.error) for r in files.extract(files.read_folder(spark, str(tmp_path / "in"))).collect()}
    assert got == {
        "a.md": ("file", "# Title\n\nbody", None), "b.bin": ("file", "b.bin (2 bytes)", None), "c.url": ("web", "https://example.org/x", None),
        "d.txt": ("file", "d.txt", None), "e.url": (None, None, "e.url: no web address in this shortcut"),
    }
    assert files.read_folder(spark, str(tmp_path / "in")).where(F.col("path").contains("staging")).count() == 0
