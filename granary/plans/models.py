"""Models behind interfaces, with deterministic defaults that need no weights.

The defaults exercise every path of the plans; they do not stand for a trained model's quality.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORD, MAX_IDS = 100, 256


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and their pairs to unit vectors."""

    def __init__(self, dim: int = 384):
        self.dim, self.name = dim, f"hashing-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = t.lower().split()
            for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embed(text: Column, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """Vectors of a text column; the model is made once a worker task."""

    def run(parts):
        model = make()
        for texts in parts:
            yield pd.Series(list(model.embed([t or "" for t in texts]).astype(np.float32)))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def embed_chunks(items: DataFrame, chunks: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """Chunks (item_id, ord, text) with vectors: of title and chunk, and of the title alone at ord -1. Chunks that bring their title are not joined with items."""
    if "title" not in chunks.columns:
        chunks = chunks.join(items.select(F.col("id").alias("item_id"), "title"), "item_id")
    said = F.when(F.col("ord") < 0, F.col("title")).otherwise(F.concat("title", F.lit("\n"), "text"))
    return chunks.select("item_id", "ord", "text", embed(said, make).alias("vec"))


def to_blob(vectors: Column) -> Column:
    """Vectors as little-endian floats, four bytes each."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(vectors)


def from_blob(blobs: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4"))

    return F.pandas_udf(run, "array<float>")(blobs)


class Pooled:
    """An embedder over a model that gives a vector a token: pools and scales to unit length, in batches of like lengths.

    ``model`` takes padded ids and a mask and gives hidden states; ``encode`` gives the ids of a
    text, of which ``most`` count; ``batch`` texts go to the model at once. Pooling is "cls", "mean" or "output" (the model pools itself). Lengths go up to the
    next of BUCKETS, so that few shapes occur. Queries and passages may have a prefix.
    """

    BUCKETS = (32, 64, 128, 256, 512)

    def __init__(self, name: str, dim: int, encode: Callable[[str], list[int]], model: Callable[[np.ndarray, np.ndarray], np.ndarray], pooling: str = "cls", prefix: str = "", most: int = 256, batch: int = 1 << 30):
        self.name, self.dim, self.encode, self.model, self.pooling, self.prefix = name, dim, encode, model, pooling, prefix
        self.most, self.batch = min(most, self.BUCKETS[-1]), batch

    def embed(self, texts: list[str]) -> np.ndarray:
        ids = [self.encode(self.prefix + t)[: self.most] for t in texts]
        width = np.array([next(b for b in self.BUCKETS if b >= len(x)) for x in ids], int)
        out = np.zeros((len(texts), self.dim))
        alike = [(w, np.flatnonzero(width == w)) for w in np.unique(width).tolist()]
        for w, rows in ((w, r) for w, every in alike for r in np.split(every, range(self.batch, len(every), self.batch))):
            padded, mask = np.zeros((len(rows), w), np.int64), np.zeros((len(rows), w), np.int64)
            for k, i in enumerate(rows):
                padded[k, : len(ids[i])] = ids[i]
                mask[k, : len(ids[i])] = 1
            hidden = self.model(padded, mask)
            if self.pooling == "cls":
                hidden = hidden[:, 0]
            elif self.pooling == "mean":
                hidden = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
            out[rows] = hidden
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def cache_key(name: str, text: Column) -> Column:
    """What a text's vector is kept under: a digest of the model's name and the text."""
    return F.sha1(F.concat(F.lit(f"{name}\0"), F.coalesce(text, F.lit(""))))


def embed_cached(texts: DataFrame, kept: DataFrame, make: Callable[[], Embedder]) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text) with vectors, and the rows (key, vec) that are new to a table of kept vectors; each text is embedded once."""
    keyed = texts.withColumn("key", cache_key(make().name, F.col("text")))
    fresh = keyed.join(kept.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text")).select("key", embed(F.col("text"), make).alias("vec"))
    return keyed.join(kept.unionByName(fresh), "key").drop("key"), fresh


def lexical_reranker(question: Column, passage: Column) -> Column:
    """A reranker without a model: the share of the question's words that a passage has."""
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.size(F.array_intersect(parts(question), parts(passage))) / F.greatest(F.size(parts(question)), F.lit(1))


def head_size(cores: int, budget_ms: float = 400, pair_ms: float = 8.7) -> int:
    """Passages to rerank within a latency budget: 6 to 10, for 2 to 6 threads."""
    threads = min(max(cores - 2, 2), 6)
    return int(min(max(budget_ms // (pair_ms * 6 / threads), 6), 10))


def basic_words(text: str) -> list[str]:
    """Words for a word-piece vocabulary: folded, with punctuation and ideographs apart."""
    out: list[str] = []
    word = ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        lone = kind[0] == "P" or (c.isascii() and kind[0] == "S") or 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF
        if kind == "Mn":
            continue
        if lone or c.isspace() or kind[0] == "C":
            out += [word] if word else []
            word = ""
            if lone:
                out.append(c)
        else:
            word += c
    return [*out, word] if word else out


class WordPieces:
    """Greedy longest-match word pieces of a vocabulary, between start and end marks."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {p: i for i, p in enumerate(vocabulary)}

    def pieces(self, word: str) -> list[int]:
        unknown = [self.ids["[UNK]"]]
        if len(word) > MAX_WORD:
            return unknown
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.ids), None)
            if end is None:
                return unknown
            out.append(self.ids[("##" if at else "") + word[at:end]])
            at = end
        return out

    def encode(self, text: str, most: int = MAX_IDS) -> list[int]:
        ids = [i for w in basic_words(text) for i in self.pieces(w)]
        return [self.ids["[CLS]"], *ids[: most - 2], self.ids["[SEP]"]]
