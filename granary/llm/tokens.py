"""Token counts by byte-pair merging on a heap and a linked list.

A text is split before each run of word marks, because no piece of the vocabulary has a
mark after another character, so no merge crosses such a place (checked when the
vocabulary is read; a vocabulary that breaks it is merged text by text). Within a segment
the best-scored adjacent pair, leftmost among equals, is popped and merged until none is
left. The count is the initial symbols less the merges; identifiers are never looked up.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MARK = "▁"
CACHE, CACHE_WORD = 300_000, 64


class PieceCounter(dict):
    """Maps a segment to its number of tokens; keeps segments of at most CACHE_WORD characters, CACHE of them."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.pieces = [sp.id_to_piece(i) for i in plain]
        #: what a heap entry begins with: the piece's rank, room for a place, and the piece
        self.entry = {p: order[sp.get_score(i)] << 64 | k for k, (i, p) in enumerate(zip(plain, self.pieces, strict=True))}
        self.falls_back = any(sp.is_byte(i) for i in range(n))
        if sp.normalize("ﬁ Å  x ") != f"{MARK}ﬁ{MARK}Å{MARK}{MARK}x{MARK}":
            raise ValueError("only vocabularies that keep texts as they are, with a mark before them, can be counted")
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*").findall

    def __missing__(self, segment: str) -> int:
        n = self.merge(segment)
        if len(segment) <= CACHE_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = n
        return n

    def cost(self, char: str) -> int:
        """Tokens of a character that nothing merges: its bytes where it is no piece."""
        return 1 if char in self.entry or not self.falls_back else len(char.encode("utf-8", "surrogatepass"))

    def merge(self, segment: str) -> int:
        """Tokens of a segment. A heap entry is one number (rank, place, piece): long segments take some 60 bytes a character."""
        entry, pieces = self.entry, self.pieces
        n = len(segment)
        part: list[str | None] = list(segment)
        costs = {c: self.cost(c) for c in set(segment)}
        total = sum(map(costs.__getitem__, segment))
        heap = [e | i << 20 for i in range(n - 1) if (e := entry.get(segment[i : i + 2])) is not None]
        if not heap:
            return total
        heapq.heapify(heap)
        after = array("q", range(1, n + 1))
        before = array("q", range(-1, n - 1))
        while heap:
            least = heapq.heappop(heap)
            i, piece = least >> 20 & 0xFFFFFFFFFFF, pieces[least & 0xFFFFF]
            left = part[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(part[j]) != len(piece) or left + part[j] != piece:
                continue
            total -= (costs[left] if len(left) == 1 else 1) + (costs[part[j]] if len(part[j]) == 1 else 1) - 1
            part[i], part[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                e = entry.get(piece + part[k])
                if e is not None:
                    heapq.heappush(heap, e | i << 20)
            h = before[i]
            if h >= 0:
                e = entry.get(part[h] + piece)
                if e is not None:
                    heapq.heappush(heap, e | h << 20)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.segments(marked))) if self.splits else self.merge(marked)


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    ``vocabulary_file`` is a file name that each worker finds among its public tokenizers,
    or a path. Null and empty texts have no bytes and no tokens. Texts of any length are
    counted whole. Repeated rows and null ids are counted each; extra columns are ignored. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_file if "/" in vocabulary_file else vocabulary(vocabulary_file))
        for batch in batches:
            n = [c.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), size.alias("n_bytes"))
    out = rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
