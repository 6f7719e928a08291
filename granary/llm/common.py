"""Pieces that the operators share: checkpoints, word hashing and grouped streams.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is also what
``bytes.split()`` returns. Words are hashed in bulk straight from Arrow's buffers.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 512 << 10
LONG_BYTES = 4 << 20
LONG_WORDS = 1 << 20

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def seeds(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1000003 + 1)) * _U(0x9E3779B97F4A7C15))


_P = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = seeds(256, 7)
_BYTES[_SPACE] = 0
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept at the largest size so far."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for factor in (base, inverse):
            p = np.full(size, factor, dtype=_U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        kept = _powers[base] = tuple(both)
    return kept[0][:n], kept[1][:n]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    where = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), where


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def pieces(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Offsets of parts of a long text of about LONG_BYTES, cut after a space; a longer word stays whole."""
    cuts = [a]
    while b - cuts[-1] > LONG_BYTES:
        at = cuts[-1] + LONG_BYTES
        while at < b:
            spaces = np.flatnonzero(_SPACE[data[at : min(at + LONG_BYTES, b)]])
            if len(spaces):
                at += int(spaces[0]) + 1
                break
            at = min(at + LONG_BYTES, b)
        cuts.append(at)
    return np.array(cuts if cuts[-1] == b else [*cuts, b], np.int64)


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each row.

    Rows of over LONG_BYTES are read in parts, so that memory beside the hashes is bounded.
    """
    if len(offsets) == 2 and offsets[1] - offsets[0] > LONG_BYTES:
        cuts = pieces(data, int(offsets[0]), int(offsets[1]))
        if len(cuts) > 2:
            h = np.concatenate([hash_words(data, cuts[k : k + 2], lower)[0] for k in range(len(cuts) - 1)])
            return h, np.array([len(h)])
    base = offsets[0]
    b = data[base : offsets[-1]]
    rel = offsets - base
    if len(b) == 0:
        return np.zeros(0, _U), np.zeros(len(rel) - 1, np.int64)
    space = _SPACE[b]
    first = np.empty(len(b), bool)
    first[0] = True
    first[1:] = space[:-1]
    inner = rel[:-1]
    first[inner[inner < len(b)]] = True
    first &= ~space
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, rel))
    if len(starts) == 0:
        return np.zeros(0, _U), counts
    up, down = powers(len(b))
    v = (_LOWER if lower else _BYTES)[b]
    v *= up
    return mix(np.add.reduceat(v, starts) * down[starts]), counts


def rolling(h: np.ndarray, k: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hashes of every k consecutive entries: len(h) - k + 1 of them, over row ends too."""
    if len(h) < k:
        return np.zeros(0, _U)
    if len(h) > LONG_WORDS + k:  # a hash does not depend on where its entries stand
        return np.concatenate([rolling(h[a : a + LONG_WORDS + k - 1], k, base) for a in range(0, len(h) - k + 1, LONG_WORDS)])
    up, down = powers(len(h), base)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these word counts laid end to end: the index of each window of k words, and its row."""
    per_row = np.maximum(counts - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), per_row)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    ends = np.cumsum(per_row)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - per_row, per_row)
    return begin[rows] + within, rows


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one of this machine's, which only a local master may use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="granary-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Gives memory that was freed back to the machine: workers live on, and the next task may need none of it."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases its task's memory at the end."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return released


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by an integer key. No more than one group and one batch are kept."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if kept and last != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
        last = keys[-1]
    if kept:
        yield pa.Table.from_batches(kept)


def by_key(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by key and sorted by it within each partition."""
    return (df.repartition(partitions, key) if partitions else df.repartition(key)).sortWithinPartitions(key)


def group_edges(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, with the total length at the end."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


ROWS_A_PART = 50_000


def kept(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint in no more parts than about ``rows`` rows need: rounds over few edges are many small jobs."""
    return checkpoint(df.coalesce(max(8, rows // ROWS_A_PART)))


def with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """Rows (u, v) with m, the least v of each u.

    The least ones are read back from files, so that both sides of the join are dealt for
    it alone: then the rows of a hub, a u with very many, can be split between tasks.
    """
    return pairs.join(kept(pairs.groupBy("u").agg(F.min("v").alias("m")), rows), "u")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component) for nodes that have an edge.

    The component is its smallest node. Large-star and small-star steps alternate, each
    over aggregates and joins, with a checkpoint after each, until nothing changes.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(e)
    while before[0]:
        n = before[0]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), n)
        small = with_least(large, n)
        e = kept(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), n)
        now = state(e)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def unpack(fn: Callable[[pa.Table], pa.Table], key: str) -> Callable:
    """A mapInArrow function that calls fn for each table of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key):
            yield from fn(table).to_batches()

    return run


def add_slices(finish: Callable[[int, np.ndarray], np.ndarray]) -> Callable:
    """mapInArrow over rows (slice, counts) sorted by slice: the sums of each slice, one at a time.

    Counts are unsigned numbers of 32 bits, those of slices under 0 doubles; sums go
    through ``finish``. Whatever the number of rows, one sum and one batch are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([finish(at, total).tobytes()], pa.binary())], ["slice", "counts"])

        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(blob.as_buffer(), np.float64 if key < 0 else np.uint32)
                if key == at:
                    total += part
                    continue
                if at is not None:
                    yield done()
                at, total = key, part.astype(np.float64 if key < 0 else np.int64)
        if at is not None:
            yield done()

    return run


def summed_slices(sent: DataFrame, finish: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """The sums of rows (slice long, counts binary) by slice."""
    return sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(add_slices(finish)), "slice long, counts binary")


HOT_KEYS = 10_000


def in_blocks(rows: DataFrame, key: str, unit: str, hot: DataFrame) -> DataFrame:
    """Columns gkey, own, lo and hi added, for comparing the rows of a key in bounded groups.

    ``hot`` has (key, blocks) for keys too large for one group. Their rows are dealt into
    blocks by ``unit`` and copied once for each pair of blocks that theirs is part of;
    other keys are one group with lo = hi. A group compares block lo with block hi.
    """
    n = hot.count()
    if n:
        rows = rows.join(F.broadcast(hot) if n <= HOT_KEYS else hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        rows = rows.withColumn("blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(unit), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return rows.withColumn("gkey", F.when(F.col("blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, "lo", "hi"))).drop("blocks", "other")
