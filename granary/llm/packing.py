"""Packing documents into sequences by lexical retrieval.

Documents are dealt into shards by content: two weighted minwise hashes draw words of each
text, by the words' weights, and documents that draw the same word first share a shard; a
word that too many draw is parted by the second draw, and what is still too large by a
hash of the rows. Each shard keeps a BM25 inverted index of its unused documents, with
document frequencies of the whole corpus; retrieval stays within it. A seed document opens a window;
when it ends inside, its best unused neighbours follow, and the one that overflows is cut
and opens the next window as the new seed. Only the last window of a shard can stay short;
it is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, checkpoint, hash_words, lean, mix, row_blocks, seeds, shuffle_width, summed_slices, text_buffers, unpack

SHARD_DOCS = 1024
SHARD_BYTES = 16 << 20
GROUPS = 8
SLOTS = 1 << 18
SLICES = 256
END_ID = 1
_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_encoders: dict[str, object] = {}


def encoder(name: str):
    """The byte-level vocabulary of ``name``.json, read from the same vocabulary's ranks.

    The library for ranks gives the identifiers of the library for .json, several times
    faster; a test holds the two against each other.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        path = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encoders[name]


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all lower-cased words of some rows, and the words of each row."""
    data, offsets = text_buffers(texts)
    parts = [hash_words(data, offsets[a : b + 1], lower=True) for a, b in row_blocks(offsets)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.concatenate([p[0] for p in parts])
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), np.concatenate([p[1] for p in parts])


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of a block each; a longer text stands alone."""
    _, offsets = text_buffers(texts)
    for a, b in row_blocks(offsets):
        yield texts.slice(a, b - a)


def doc_terms(slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (document, slot, frequency), ordered by document and slot."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    pairs, tf = np.unique(doc * SLOTS + slots, return_counts=True)
    return pairs // SLOTS, pairs % SLOTS, tf


def frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int, float]:
    """Documents that hold each slot, documents, and their mean number of words, over the whole corpus.

    Each task sends one table of SLOTS counts in slices, whatever it reads; the slices are
    summed apart, and the driver gets one table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(SLOTS, np.uint32), 0, 0
        for batch in batches:
            for texts in parts_of(batch.column(0)):
                slots, counts = word_slots(texts)
                df += np.bincount(doc_terms(slots, counts)[1], minlength=SLOTS).astype(np.uint32)
                n, words = n + len(counts), words + int(counts.sum())
        cells = [c.tobytes() for c in np.split(df, SLICES)] + [np.array([n, words], np.float64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([*range(SLICES), -1], pa.int64()), pa.array(cells, pa.binary())], ["slice", "counts"])

    sent = docs.select(text).mapInArrow(lean(count), "slice long, counts binary")
    parts = {r.slice: bytes(r.counts) for r in summed_slices(sent, lambda _, total: total).collect()}
    if not parts:
        return np.zeros(SLOTS, np.int64), 0, 0.0
    n, words = np.frombuffer(parts[-1], np.float64).tolist()
    return np.frombuffer(b"".join(parts[i] for i in range(SLICES)), np.int64), int(n), words / max(n, 1)


class Index:
    """BM25 postings of one shard."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, df: np.ndarray, n: int, mean: float, k1: float = 1.2, b: float = 0.75):
        doc, term, tf = doc_terms(slots, counts)
        idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
        weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * counts[doc] / max(mean, 1)))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order].astype(np.int32), weight[order]
        _, where, size = np.unique(term, return_inverse=True, return_counts=True)
        self.size, self.begin = size, np.cumsum(size) - size
        self.own = where
        self.edges = np.searchsorted(doc, np.arange(len(counts) + 1))
        self.n = len(counts)

    def neighbours(self, seed: int) -> np.ndarray:
        """Scores of all documents for the words of one."""
        terms = self.own[self.edges[seed] : self.edges[seed + 1]]
        size, begin = self.size[terms], self.begin[terms]
        ends = np.cumsum(size)
        if len(terms) == 0:
            return np.zeros(self.n)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def order_of(index: Index, lengths: np.ndarray, window: int) -> list[int]:
    """The order in which a shard's documents are laid end to end."""
    unused = np.ones(index.n, bool)
    out: list[int] = []
    filled, seed, cursor = 0, -1, 0
    scores = None
    for _ in range(index.n):
        pick = -1
        if seed >= 0 and filled % window:
            if scores is None:
                scores = index.neighbours(seed)
            live = np.where(unused, scores, 0)
            best = int(np.argmax(live))
            pick = best if live[best] > 0 else -1
        if pick < 0:
            while not unused[cursor]:
                cursor += 1
            pick = cursor
        before = filled // window
        unused[pick] = False
        out.append(pick)
        filled += int(lengths[pick])
        if seed < 0 or filled // window > before:  # it overflows: it is cut and opens the next window
            seed, scores = pick, None
    return out


def draws(stats, n: int):
    """mapInArrow: (doc_id, text) with columns m1 and m2 added: the words that a text draws, 0 where it has none."""
    salts = seeds(2, 41)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = stats.value
        weight = np.log1p((n - df + 0.5) / (df + 0.5))
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            drawn = np.zeros((2, batch.num_rows), np.float64)
            for a, b in row_blocks(offsets):
                h, counts = hash_words(data, offsets[a : b + 1], lower=True)
                some = np.flatnonzero(counts)
                if len(some):
                    begin = (np.cumsum(counts) - counts)[some]
                    w = weight[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                    for k, salt in enumerate(salts):
                        u = ((mix(h ^ salt) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
                        drawn[k, a + some] = np.minimum.reduceat(-np.log(u) / w, begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m.view(np.int64)) for m in drawn)], ["doc_id", "text", "m1", "m2"])

    return run


def deal(rows: DataFrame, stats, n: int, shards: int) -> DataFrame:
    """Rows (doc_id, text) with a column shard: those that draw the same word share one, unless they are too many.

    A group is too large over one part in GROUPS of a shard's documents or bytes.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    drawn = rows.mapInArrow(lean(draws(stats, n)), "doc_id long, text string, m1 long, m2 long")
    counts = checkpoint(drawn.groupBy("m1", "m2").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")))
    parts = F.ceil(F.greatest(F.col("n") * F.lit(GROUPS / SHARD_DOCS), F.col("bytes") * F.lit(GROUPS / SHARD_BYTES)))
    first = counts.groupBy("m1").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where(parts > 1).select("m1", F.lit(True).alias("hot"))
    second = counts.where(parts > 1).select("m1", "m2", parts.cast("long").alias("parts"))
    for keys, table in ((["m1"], checkpoint(first)), (["m1", "m2"], checkpoint(second))):
        drawn = drawn.join(F.broadcast(table) if table.count() <= HOT_KEYS else table, keys, "left")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("parts", F.lit(1)))
    group = F.when(F.col("hot"), F.xxhash64("m1", "m2", part)).otherwise(F.xxhash64("m1"))
    return drawn.select("doc_id", "text", F.pmod(group, F.lit(shards)).cast("long").alias("shard"))


def lay(order: list[int], ids: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents laid end to end."""
    total = sum(len(ids[d]) for d in order)
    full, rest = divmod(total, window)
    sizes = [window] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    out = []
    seq, offset = 0, 0
    for d in order:
        start = 0
        while start < len(ids[d]):
            n = min(len(ids[d]) - start, sizes[seq] - offset)
            out.append((d, start, n, seq, offset))
            start, offset = start + n, offset + n
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0
    return out


def pack(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of packed sequences.

    A document is its tokens and the end identifier; ``ids`` holds those of a piece as
    little-endian unsigned 32-bit numbers. Every identifier lies in one piece. Sequences
    hold ``window`` tokens, except for the powers of two that end a shard. A null text is
    empty: its end identifier is packed. Repeated rows are packed each; rows with a null id
    are packed with a null id. Extra columns are ignored. An empty table gives no pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    df, n, mean = frequencies(rows, "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-n // SHARD_DOCS), -(-size // SHARD_BYTES))
    stats = rows.sparkSession.sparkContext.broadcast(df)

    def fn(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        enc = encoder(vocabulary)
        ids = [np.append(enc.encode_to_numpy(t.as_py() or "", allowed_special="all").astype("<u4"), np.array([END_ID], "<u4")) for t in texts]
        index = Index(*word_slots(texts), stats.value, n, mean)
        order = order_of(index, np.array([len(x) for x in ids]), window)
        found = lay(order, ids, window)
        doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*found, strict=True))
        shard = table.column("shard")[0].as_py()
        return pa.table(
            [
                table.column("doc_id").combine_chunks().take(pa.array(doc)),
                pa.array(start),
                pa.array(length),
                pa.array([ids[d][s : s + k].tobytes() for d, s, k, _, _ in found], pa.binary()),
                pa.array(np.array([len(x) for x in ids])[doc]),
                pa.array(seq + (shard << 32)),
                pa.array(offset),
            ],
            schema=pa.schema(_PIECE),
        )

    def each(table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        return pa.concat_tables([fn(table.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    parts = max(shuffle_width(docs.sparkSession), -(-size // SHARD_BYTES))
    dealt = deal(rows, stats, n, shards).repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "text")
    return dealt.mapInArrow(lean(unpack(each, "shard")), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
