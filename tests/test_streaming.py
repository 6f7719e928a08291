"""Streams with keyed state: batches with edits, and edits inside and outside of the quiet time."""

from __future__ import annotations

import collections
import datetime

from pyspark.sql import functions as F

from granary.streaming import ingest as I
from granary.streaming import notes as N

ITEM = f"{I.ITEMS}, error string"


def send(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def item(i, h, content, at=0, error=None):
    return (i, f"t{i}", "text", None, content, h, at, ["x"], error)


def test_ingest_in_batches(spark, tmp_path):
    inbox, vault = str(tmp_path / "inbox"), str(tmp_path / "vault")

    def run(rows):
        send(spark, inbox, rows, ITEM)
        q = I.start(spark.readStream.schema(ITEM).parquet(inbox), vault)
        q.awaitTermination()
        assert q.exception() is None
        return q.lastProgress

    run([item(1, "a", "one"), item(2, "b", "two"), item(3, "a", "one"), item(4, "c", None, error="unreadable")])
    I.compact(spark, vault, str(tmp_path / "base"))
    later = run([item(5, "a", "one, edited", 7), item(6, "b", "two"), item(7, "d", None), item(8, "d", "")])
    run([item(9, "a", "one", 9), item(10, "c", "readable now")])
    want = {"a": (1, "one", 9, 3), "b": (2, "two", 0, 1), "d": (7, None, 0, 1), "c": (10, "readable now", 0, 1)}
    for compacted in (None, str(tmp_path / "base")):
        got = {r.hash: (r.id, r.content, r.added_at, r.version) for r in I.current(spark, vault, compacted).collect()}
        assert got == want
    I.compact(spark, vault, str(tmp_path / "base2"), str(tmp_path / "base"))
    assert spark.read.parquet(str(tmp_path / "base2")).count() == 4
    assert {r.action: r.n for r in I.report(spark, vault).collect()} == {"added": 4, "updated": 2, "duplicate": 3, "failed": 1}
    state = later["stateOperators"][0] if isinstance(later, dict) else later.stateOperators[0]
    assert (state["numRowsUpdated"] if isinstance(state, dict) else state.numRowsUpdated) <= 4  # the batch's own keys


def judged(batches):
    """The vault after these batches, judged row by row."""
    vault = {}
    for batch in batches:
        for i, _, _, _, content, h, at, _, error in sorted(batch, key=lambda r: (r[0], r[6])):
            if error is None and (h not in vault or (vault[h][1] or "") != (content or "")):
                first, _, _, n = vault.get(h, (i, None, 0, 0))
                vault[h] = (first, content, at, n + 1)
    return vault


def test_states_of_many_identities_take_few_requests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BUCKETS", 2, raising=False)
    inbox, vault = str(tmp_path / "inbox"), str(tmp_path / "vault")
    first = [item(i, f"h{i}", f"text {i}") for i in range(60)] + [item(900, None, "no hash"), item(901, None, "another")]
    grown = [item(1000 + i, f"h{i}", f"text {i}" if i % 3 else f"edited {i}", 5) for i in range(800)] + [item(1900, None, "another"), item(1901, "h5", "late", 1, "unreadable")]
    last = [item(2000, "h3", "the last", 9), item(2001, "h4", "text 4", 9), item(2002, "h799", None, 9)]
    updated = []
    for batch in (first, grown, last):
        send(spark, inbox, batch, ITEM)
        q = I.start(spark.readStream.schema(ITEM).parquet(inbox), vault)
        q.awaitTermination()
        updated.append(q.lastProgress["stateOperators"][0]["numRowsUpdated"])
    assert {r.hash: (r.id, r.content, r.added_at, r.version) for r in I.current(spark, vault).collect()} == judged((first, grown, last))
    assert updated[0] <= 8 and updated[1] <= 80  # of 61 and some 760 identities that are new or edited
    assert updated[2] <= 3  # whatever the vault holds


def edit(note, ms, content):
    return (note, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=ms), content)


def test_edits_settle_when_left_alone(spark, tmp_path):
    inbox, schema = str(tmp_path / "inbox"), "note long, ts timestamp, content string"
    zero = int(edit(0, 0, "")[1].timestamp() * 1000)

    def run(rows):
        send(spark, inbox, rows, schema)
        found = N.settled(spark.readStream.schema(schema).parquet(inbox), delay="2 seconds")
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        return collections.Counter((r.note, r.at - zero, r.content) for r in spark.read.schema(N.SETTLED).parquet(str(tmp_path / "out")).collect())

    first = run([edit(1, 0, "a"), edit(1, 600, "ab"), edit(1, 1201, "abc"), edit(2, 100, "x"), edit(3, 1000, "n"), edit(3, 1000, "m")])
    assert first == {(1, 600, "ab"): 1}  # 600 ms put an edit off, 601 do not; the others wait for the watermark
    second = run([edit(2, 500, "xy"), edit(1, 1100, "out of order"), edit(1, 1700, "abcd"), edit(9, 10_000, "clock")])
    assert second == first + collections.Counter([(2, 500, "xy"), (1, 1700, "abcd"), (3, 1000, "n")])
    third = run([edit(2, 5_000, "too late"), edit(2, 9_000, "in time"), edit(9, 20_000, "clock")])
    assert third == second + collections.Counter([(2, 9_000, "in time"), (9, 10_000, "clock")])


def test_last_edits(spark):
    rows = spark.createDataFrame([edit(1, 5, "b"), edit(1, 2, "a"), edit(2, 1, "c")], "note long, ts timestamp, content string")
    assert {(r.note, r.content) for r in N.last_edits(rows).collect()} == {(1, "b"), (2, "c")}
