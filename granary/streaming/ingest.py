"""Ingest as a stream with keyed state.

Each identity (hash) has one small state: the item that came first, a digest of its
content, and how often it changed. A state of its own costs several requests to Spark for
each identity of a batch, so identities are dealt into ``BUCKETS`` keys, and the states of
a bucket into slots of some ``SLOT`` states, each read and written by one request; slots
double in number as a bucket fills. A batch reads the slots that its identities fall into
and appends what changed, so its work follows its rows, whatever the vault holds. The vault
is the last change of each identity; compacting writes that as a table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Collection, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ITEMS = "id long, title string, kind string, source string, content string, hash string, added_at long, tags array<string>"
CHANGES = f"{ITEMS}, action string, version long"
FIELDS = [c.split()[0] for c in ITEMS.split(", ")]
BUCKETS = 4096  # of the rows of a batch, a task holds those of one bucket at a time
SLOT = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slots(n: int) -> int:
    """How many slots a bucket of ``n`` states has."""
    return 1 << (n // SLOT).bit_length()


def slot(identity: str | None, of: int) -> int:
    return zlib.crc32((identity or "").encode()) % of


class Judge(StatefulProcessor):
    """Rows of the identities of a bucket, those of each by id and time: added, updated, duplicate or failed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "slot int", "hash array<string>, id array<long>, digest array<string>, version array<long>")
        self.held = handle.getValueState("held", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found: dict[str | None, list[Row]] = {}
        for r in rows:
            found.setdefault(r.hash, []).append(r)
        n = (self.held.get() or (0,))[0]
        states = self.read({slot(identity, slots(n)) for identity in found}) if n else {}
        known, changed = len(states), set()
        for identity, same in found.items():
            kept = before = states.get(identity)
            for r in sorted(same, key=lambda r: (r.id is None, r.id or 0, r.added_at or 0)):
                if r.error is not None:
                    yield self.change(r, r.id, "failed", None)
                    continue
                digest = hashlib.sha256((r.content or "").encode()).hexdigest()
                if kept is None:
                    kept = (r.id, digest, 1)
                    yield self.change(r, r.id, "added", 1)
                elif kept[1] != digest:
                    kept = (kept[0], digest, kept[2] + 1)
                    yield self.change(r, kept[0], "updated", kept[2])
                else:
                    yield self.change(r, r.id, "duplicate", None)
            if kept is not before:
                states[identity] = kept
                changed.add(identity)
        self.write(states, changed, n, n + len(states) - known)

    def read(self, wanted: Collection[int]) -> dict[str | None, tuple]:
        """The states of these slots by identity."""
        packed = [p for s in wanted if (p := self.kept.getValue((s,))) is not None]
        return {identity: tuple(kept) for p in packed for identity, *kept in zip(*p, strict=True)}

    def write(self, states: dict[str | None, tuple], changed: set[str | None], n: int, after: int) -> None:
        """Writes the slots of what changed, all of them when the bucket, now of ``after`` states, gets more."""
        of = slots(after)
        if of == slots(n):
            dealt = {slot(identity, of): [] for identity in changed}
        else:
            dealt = {s: [] for s in range(of)}
            states = (self.read(range(slots(n))) if n else {}) | states
        for identity, kept in states.items():
            if (s := slot(identity, of)) in dealt:
                dealt[s].append((identity, *kept))
        for s, packed in dealt.items():
            self.kept.updateValue((s,), tuple(map(list, zip(*packed, strict=True))) or ([], [], [], []))
        if after > n:
            self.held.update((after,))

    @staticmethod
    def change(r: Row, item: int, action: str, version: int | None) -> Row:
        """What the vault takes over: all of a row that changed it, of another its names alone."""
        content, tags = (r.content, r.tags) if version else (None, None)
        return Row(id=item, title=r.title, kind=r.kind, source=r.source, content=content, hash=r.hash, added_at=r.added_at, tags=tags, action=action, version=version)

    def close(self) -> None:
        pass


def changes(items: DataFrame) -> DataFrame:
    """A stream of items (and their error, if any) as a stream of changes: the rows of ``CHANGES``.

    Its states are those of buckets: a checkpoint of identities' own states cannot be gone on with.
    """
    rows = items.select(*FIELDS, (F.col("error") if "error" in items.columns else F.lit(None).cast("string")).alias("error"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(BUCKETS))).groupBy("bucket").transformWithState(Judge(), CHANGES, "Append", "None")


def start(items: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """Starts the ingest of a stream of items; with ``once`` it ends when all that is there is in.

    Changes are appended to a folder of Parquet that Spark's file sink keeps exactly once;
    states are in RocksDB, with their checkpoints beside. Rows without a hash share one state.
    """
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = changes(items).writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/progress").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def all_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(f"{path}/changes")


def last_versions(changed: DataFrame) -> DataFrame:
    """One row for each identity: its last version."""
    rest = [f for f in [*FIELDS, "version"] if f != "hash"]
    last = changed.where("version is not null").groupBy("hash").agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return last.select("hash", "last.*").select(*FIELDS, "version")


def current(spark: SparkSession, path: str, compacted: str | None = None) -> DataFrame:
    """The vault: the items of ``ITEMS`` with their version. ``compacted`` is a table that ``compact`` wrote earlier."""
    changed = all_changes(spark, path).drop("action")
    if compacted is not None:
        changed = changed.unionByName(spark.read.parquet(compacted))
    return last_versions(changed)


def compact(spark: SparkSession, path: str, to: str, compacted: str | None = None) -> None:
    """Writes the vault as one table. It may be read with later changes, or with the same ones again: versions tell them apart."""
    current(spark, path, compacted).write.mode("overwrite").parquet(to)


def report(spark: SparkSession, path: str) -> DataFrame:
    """How many rows were added, updated, duplicates or failed."""
    return all_changes(spark, path).groupBy("action").agg(F.count("*").alias("n"))


def new_items(items: DataFrame) -> DataFrame:
    """A stream with each hash once."""
    return items.dropDuplicates(["hash"])
