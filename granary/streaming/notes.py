"""Note edits as a stream: an edit counts once its note was left alone for a while.

The pending edit of a note is a keyed state with an event-time timer; a later edit puts the
timer off. The watermark fires timers, and drops edits that come later than it allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.streaming.ingest import ROCKS

QUIET_MS = 600
SETTLED = "note long, at long, content string"


class Debounce(StatefulProcessor):
    """Edits of one note: each that no other follows within ``quiet`` milliseconds."""

    def __init__(self, quiet: int = QUIET_MS):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "at long, content string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = last = self.pending.get()
        for at, content in sorted(((r.at, r.content) for r in rows), key=lambda e: (e[0], e[1] or "")):
            if last is not None and at < last[0]:
                continue  # a later edit is known already
            if last is not None and at - last[0] > self.quiet:
                yield Row(note=key[0], at=last[0], content=last[1])
            last = (at, content)
        if last is not before:
            if before is not None:
                self.handle.deleteTimer(before[0] + self.quiet)
            self.pending.update(last)
            self.handle.registerTimer(last[0] + self.quiet)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, content = self.pending.get()
        self.pending.clear()
        yield Row(note=key[0], at=at, content=content)

    def close(self) -> None:
        pass


def settled(edits: DataFrame, quiet: int = QUIET_MS, delay: str = "5 seconds") -> DataFrame:
    """The stream of edits (note, ts timestamp, content) as a stream of settled ones (note, at in milliseconds, content).

    Of equal times the last content in order counts. Edits that come more than ``delay``
    after later ones of any note are left out.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = edits.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("note").transformWithState(Debounce(quiet), SETTLED, "Append", "EventTime")


def last_edits(edits: DataFrame) -> DataFrame:
    """Note edits (note, ts, content) with the last content of each note."""
    return edits.groupBy("note").agg(F.max_by("content", "ts").alias("content"), F.max("ts").alias("ts"))
