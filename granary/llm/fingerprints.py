"""Document fingerprints by context-triggered piecewise hashing.

A chunk of a text ends where a hash of the last eight bytes ends in k ones; 2^k is the
block size, chosen by the text's length for LENGTH chunks or some fewer, and halved while
there are under FEWEST. A signature has a symbol for each chunk, LENGTH at most, the last
one for all that is left. A fingerprint has the signatures
of a block size and of its double, so that texts whose block sizes differ by a factor of
two still compare. An edit changes the symbols of the chunks it touches and no others.

Fingerprints and likenesses are columns. To compare each document with its next one, ids
and hashes are dealt by range first: the first key of each part, one row a part, tells
every document its part, and which documents also stand as the next one of the part before.
So texts are dealt once, and no task holds more than one part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, mix, shuffle_width

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LENGTH, FEWEST = 8, 64, 16
#: Signatures are alike only if they share this many symbols in a row (half of a shorter one than twice that); no symbol counts over REPEATS times in a row.
RUN, REPEATS = 7, 3
SEGMENT = 1 << 20
PART_BYTES = 64 << 20


def chunk_ends(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks for blocks of 2^k, and the ones that each hash ends in; a segment at a time, however long the text."""
    padded = bytes(WINDOW - 1) + data
    ones = np.uint64((1 << k) - 1)
    ends, levels = [], []
    for at in range(0, len(data), SEGMENT):
        size = min(SEGMENT, len(data) - at)
        h = mix(np.ndarray(size, "<u8", padded, at, (1,)).astype(np.uint64))
        some = np.flatnonzero(h & ones == ones)
        h = h[some]
        ends.append(some + (at + 1))
        levels.append(np.log2((~h & (h + np.uint64(1))).astype(np.float64)).astype(np.int64))
    return (np.concatenate(ends), np.concatenate(levels)) if ends else (np.zeros(0, np.int64),) * 2


def signature(data: memoryview, ends: np.ndarray) -> str:
    cuts = [0, *ends[: LENGTH - 1].tolist(), len(data)]
    return "".join([SYMBOLS[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b])


def fingerprint_of(data: bytes) -> str:
    """``k:signature at 2^k:signature at 2^(k + 1)``."""
    k = ((len(data) - 1) // LENGTH).bit_length() if data else 0
    ends, levels = chunk_ends(data, k)
    while len(ends) < FEWEST and k:
        k -= 1
        ends, levels = chunk_ends(data, k)
    view = memoryview(data)
    return f"{k}:{signature(view, ends)}:{signature(view, ends[levels > k])}"


def common_symbols(a: str, b: str) -> int:
    """The length of the longest common subsequence, 64 comparisons a step."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:
        met = state & where.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def shortened(s: str) -> str:
    return "".join([c for i, c in enumerate(s) if i < REPEATS or s[i - REPEATS : i] != c * REPEATS])


def alike(a: str, b: str) -> float:
    """1 less the edit distance (a symbol is put in or taken out) over both lengths; 0 without a common run of symbols."""
    a, b = shortened(a), shortened(b)
    run = min(RUN, max(1, min(len(a), len(b)) // 2))
    if not a or not b or not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    return 2 * common_symbols(a, b) / (len(a) + len(b))


def likeness_of(one: str, other: str) -> float:
    if one == other:
        return 1.0
    (k, a, aa), (m, b, bb) = one.split(":"), other.split(":")
    pairs = {0: [(a, b), (aa, bb)], 1: [(a, bb)], -1: [(aa, b)]}.get(int(k) - int(m), [])
    return max((alike(*p) for p in pairs), default=0.0)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty. Equal texts have equal ones."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(b or b"") for b in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text.cast("binary"))


def likeness(one: Column, other: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1: 1 for equal ones, 0 where block sizes are over a factor of two apart."""

    def run(ones: pa.Array, others: pa.Array) -> pa.Array:
        return pa.array([likeness_of(a, b) for a, b in zip(ones.to_pylist(), others.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(one, other)


def with_next(docs: DataFrame, text: str, id_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Rows of ``docs`` (id, text, and the columns to carry): next_text and next_<carried> of the next id added, by falling ids; the last row's next is the first.

    Null ids come last. Rows that share an id follow by hash and text.
    """
    h = F.xxhash64(text)
    light = checkpoint(docs.select(F.col(id_col).alias("id"), h.alias("h"), F.octet_length(text).alias("size")))
    size = light.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), -(-size // PART_BYTES))
    dealt = light.repartitionByRange(parts, F.col("id").desc_nulls_last(), F.col("h").desc())
    first = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "h")).alias("key"))

    def order(i, h):
        return (i is not None, i if i is not None else 0, h)

    firsts = sorted(order(r.key.id, r.key.h) for r in first.collect())

    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The part of a row; for the first rows of a part, also the part before."""
        out = []
        for key in map(order, ids.to_pylist(), hashes.to_pylist()):
            at = bisect_left(firsts, key)  # parts count down: the highest keys are in the last
            out.append([at, (at + 1) % len(firsts)] if firsts[at] == key else [at])
        return pa.array(out, pa.list_(pa.int32()))

    placed = docs.withColumn("_h", h).withColumn("_parts", F.arrow_udf(place, "array<int>")(F.col(id_col), F.col("_h")))
    placed = placed.select("*", F.posexplode("_parts").alias("_guest", "_part"))
    turn = Window.partitionBy("_part").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.col("_h").desc(), F.col(text).desc())
    followed = placed.withColumns({f"next_{c}": F.lead(c).over(turn) for c in (text, *carry)})
    return followed.where("_guest = 0").drop("_h", "_parts", "_guest", "_part")


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of ``docs``.

    The edited text has the last third of a text's code points replaced by the first as
    many (or all) of the next document's, by falling id. The next of the last is the
    first; a single document is its own next. A null text counts as empty. Null ids come
    last; they and repeated ids follow by a hash of their text, and stand in one task.
    Extra columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("fingerprint", fingerprint(F.col("text")))
    both = with_next(rows, "text", "doc_id", ("fingerprint",))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    out = both.select("doc_id", "n_chars", edited.alias("edited"), "fingerprint", "next_fingerprint")
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = edited_by_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
