"""A vault kept as tables with stamps beside them: what made them, and which of their versions counts.

A write leaves its tables in new folders and then adds one commit of stamps; readers take the
last stamp of each key. So a write that was lost changes nothing, and of two writers that began
from one commit the second fails. Tables of older schemas are read with the columns they lack.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.edits import reread, stale_items

#: Columns that came later, with what older vaults have for them.
LATER = {"custom_title": "false", "tags": "cast(array() as array<string>)", "cursor": "''", "stored": "''"}
CHUNKS = "item_id long, ord int, text string"
STAMPS = "key string, value string, commit long"


@dataclass(frozen=True)
class Opened:
    """A vault as it is to be used by a program of some embedding model and text version.

    ``chunks`` is empty where either differs from what made them. ``stale`` says that texts are
    to be read again; it stays until ``settle`` has done so, over failures and restarts.
    """

    path: str
    commit: int
    items: DataFrame
    chunks: DataFrame
    model: str
    text: str
    stale: bool
    renewed: bool


def stamps(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """The last value of each key, and its commit. There is a row for each of a handful of keys and commits."""
    try:
        said = spark.read.schema(STAMPS).parquet(f"{path}/meta")
        last = said.groupBy("key").agg(F.max_by("value", "commit").alias("value"), F.max("commit").alias("commit"))
        return {r.key: (r.value, r.commit) for r in last.collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def write(path: str, items: DataFrame, chunk: Callable[[DataFrame], DataFrame] | None, model: str, text: str, commit: int = 0) -> None:
    """Writes a vault's items, and the chunks (item_id, ord, text) that ``chunk`` cuts of what was written, as the commit after ``commit``.

    Without ``chunk`` only items are written; chunks stay, and so does what the stamps tell of them.
    """
    spark = items.sparkSession
    marks = {"items": f"items-{commit + 1}-{uuid.uuid4().hex}"}
    items.write.parquet(f"{path}/{marks['items']}")
    if chunk is not None:
        marks |= {"embed_model": model, "text_version": text, "chunks": marks["items"].replace("items", "chunks", 1)}
        chunk(spark.read.parquet(f"{path}/{marks['items']}")).write.parquet(f"{path}/{marks['chunks']}")
    said = spark.createDataFrame(sorted(marks.items()), "key string, value string")
    said.coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta/commit={commit + 1}")


def migrated(items: DataFrame) -> DataFrame:
    """Items with every later column: those that the table lacks have what an older vault has for them, and so have nulls."""
    value = lambda c, default: F.coalesce(F.col(c), F.expr(default)) if c in items.columns else F.expr(default)
    return items.withColumns({c: value(c, default) for c, default in LATER.items()})


def open_vault(spark: SparkSession, path: str, model: str, text: str) -> Opened:
    """Opens a vault for a program. What made its chunks and texts is told by its stamps alone."""
    found = stamps(spark, path)
    if "items" not in found:
        raise FileNotFoundError(f"no vault in {path}")
    value = {k: v for k, (v, _) in found.items()}
    stale = value.get("text_version") != text
    renewed = stale or value.get("embed_model") != model
    whole = not renewed and "chunks" in value
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/{value['chunks']}") if whole else spark.createDataFrame([], CHUNKS)
    items = migrated(spark.read.parquet(f"{path}/{value['items']}"))
    return Opened(path, max(n for _, n in found.values()), items, chunks, model, text, stale, renewed)


def to_read(vault: Opened) -> DataFrame:
    """Rows (id, source) of the items whose files are to be read again; none where the texts are of this version."""
    return stale_items(vault.items, 0, int(vault.stale))


def settle(vault: Opened, extract: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame]) -> Opened:
    """Brings a vault up to its program and writes it, stamped: stale texts are read again, and all is cut anew.

    ``extract`` gives rows (path, content, error) for sources (source), each once; what cannot be read
    keeps its text. ``chunk`` cuts items into rows (item_id, ord, text). A vault of these stamps stays as it is.
    """
    if not vault.renewed:
        return vault
    stale = to_read(vault)
    items = reread(vault.items, stale, extract(stale.select("source").distinct())) if vault.stale else vault.items
    spark = items.sparkSession
    write(vault.path, items, chunk, vault.model, vault.text, vault.commit)
    return open_vault(spark, vault.path, vault.model, vault.text)
