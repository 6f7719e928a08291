"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its score depends on features of the line and of the lines
before and after it, and on the label of the line before. Forward and backward messages
give each line's marginal; their mean by length is the document's quality, which a
logistic curve turns into a probability.

The field is fitted on a bounded sample of labelled documents whose lines take their
document's label. Texts are the only input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hash_words, lean, row_blocks, text_buffers

SAMPLE_DOCS = 4000
SAMPLE_LINES = 2000
SAMPLE_TOTAL = 200_000

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:?'\"()-", b"!", b"|", bytes(range(128, 256)), bytes(range(0, 9)) + bytes(range(14, 32))]
_PACKED = np.zeros((5, 256), np.int64)
for _i, _chars in enumerate(_KINDS):
    _PACKED[_i // 2, list(_chars)] += 1 << (32 * (_i % 2))
_SYMBOLS = [c for c in range(33, 127) if not any(c in k for k in _KINDS)]
_PACKED[4, _SYMBOLS] += 1 << 32
N_FEATURES = 23


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lines of all rows, with the end of the data added, and lines of each row."""
    base, end = offsets[0], offsets[-1]
    breaks = np.flatnonzero(data[base:end] == 10) + base + 1
    per_row = np.diff(np.searchsorted(breaks, offsets, side="right"))
    # a break that ends a row belongs to that row: its last line is empty and starts at the row's end
    first = np.searchsorted(breaks, offsets[:-1], side="right")
    n = per_row + 1
    starts = np.empty(int(n.sum()) + 1, np.int64)
    at = np.cumsum(n) - n
    starts[at] = offsets[:-1]
    inner = np.arange(len(breaks) if len(offsets) > 1 else 0)
    row = np.repeat(np.arange(len(n)), per_row)
    starts[at[row] + 1 + inner[: len(row)] - (np.cumsum(per_row) - per_row)[row]] = breaks[first[row] + (inner[: len(row)] - (np.cumsum(per_row) - per_row)[row])]
    starts[-1] = end
    return starts, n


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of some rows: features, lengths in bytes, and the lines of each row."""
    starts, n = lines_of(data, offsets)
    begin, end = starts[:-1], starts[1:]
    size = (end - begin).astype(np.float64)
    b = data[offsets[0] : offsets[-1]]
    lo, hi = begin - offsets[0], end - offsets[0]
    share = []
    for packed in _PACKED:
        total = np.zeros(len(b) + 1, np.int64)
        np.cumsum(packed[b], out=total[1:])
        both = total[hi] - total[lo]
        share += [both & 0xFFFFFFFF, both >> 32]
    share = np.stack(share, axis=1) / np.maximum(size, 1)[:, None]
    h, words = hash_words(data, starts)
    line = np.repeat(np.arange(len(words)), words)
    same1, same2 = np.zeros(len(words)), np.zeros(len(words))
    for gap, same in ((1, same1), (2, same2)):
        if len(h) > gap:
            equal = (h[gap:] == h[:-gap]) & (line[gap:] == line[:-gap])
            same += np.bincount(line[gap:][equal], minlength=len(words))
    w = np.maximum(words, 1)
    whole = np.zeros(len(words), np.uint64)
    if len(h):
        np.add.at(whole, line, h * (np.arange(len(h), dtype=np.uint64) - np.repeat(np.cumsum(words) - words, words).astype(np.uint64) + np.uint64(3)))
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((whole, row))
    twin = (row[order][1:] == row[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    again = np.zeros(len(words))
    again[order[1:][twin]] = 1
    again[order[:-1][twin]] = 1
    x = np.empty((len(words), N_FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 1:11] = share
    x[:, 11] = np.log1p(size) / 8
    x[:, 12] = words / np.maximum(size, 1)
    x[:, 13] = np.minimum(size / w / 20, 2)
    x[:, 14], x[:, 15] = same1 / w, same2 / w
    x[:, 16] = again
    x[:, 17] = words < 3
    x[:, 18] = np.minimum(1, 8 * (share[:, 9] + share[:, 5] + share[:, 6]))
    x[:, 19] = np.minimum(1, 2 * share[:, 1])
    x[:, 20] = np.minimum(1, 4 * same1 / w)
    x[:, 21] = size <= 1
    x[:, 22] = np.minimum(1, 5 * share[:, 2])
    return x, size, n


def with_neighbours(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Features of each line beside those of the lines before and after it; zeros past the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(n)
    before[ends - n] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def step(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the next line, before its own score, from log-odds of this one; t is by [label, next label]."""
    return np.logaddexp(t[0, 1], a + t[1, 1]) - np.logaddexp(t[0, 0], a + t[1, 0])


def messages(z: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds of each line with its score, and backward log-odds without it."""
    ends = np.cumsum(n)
    begin = ends - n
    order = np.argsort(-n, kind="stable")
    live = np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
    fore, back = z.astype(np.float64), np.zeros(len(z))
    for k in range(1, len(live)):
        at = begin[order[: live[k]]] + k
        fore[at] += step(fore[at - 1], t)
        at = ends[order[: live[k]]] - 1 - k
        back[at] = step(z[at + 1] + back[at + 1], t.T)
    return fore, back


class Field:
    """Weights of the lines, transitions, and the curve from quality to probability."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, slope: float, shift: float):
        self.weights, self.moves, self.slope, self.shift = weights, moves, slope, shift

    def quality(self, x: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        if len(n) == 0:
            return np.zeros(0)
        z = with_neighbours(x, n) @ self.weights
        fore, back = messages(z, n, self.moves)
        weight = size + 1
        begin = np.cumsum(n) - n
        return np.add.reduceat(sigmoid(fore + back) * weight, begin) / np.add.reduceat(weight, begin)

    def score(self, x: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        q = np.clip(self.quality(x, size, n), 1e-4, 1 - 1e-4)
        return sigmoid(self.slope * np.log(q / (1 - q)) + self.shift)


def fit(x: np.ndarray, size: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over the whole sample; documents weigh alike."""
    if len(n) == 0:
        return Field(np.zeros(3 * N_FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    f = with_neighbours(x, n).astype(np.float64)
    label = np.repeat(y.astype(np.float64), n)
    weight = np.repeat(1.0 / n, n) / len(n)
    begin = np.cumsum(n) - n
    inner = np.ones(len(label), bool)
    inner[begin] = False
    inner = np.flatnonzero(inner)
    theta = np.zeros(f.shape[1] + 4)
    theta[-4:] = [0.5, -0.5, -0.5, 0.5]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        z, t = f @ theta[:-4], theta[-4:].reshape(2, 2)
        fore, back = messages(z, n, t)
        grad = np.concatenate([f.T @ (weight * (sigmoid(fore + back) - label)), np.zeros(4)])
        if len(inner):  # marginals of pairs against the labels
            a, c = fore[inner - 1], z[inner] + back[inner]
            pair = np.stack([np.zeros(len(inner)) + t[0, 0], c + t[0, 1], a + t[1, 0], a + c + t[1, 1]])
            pair = np.exp(pair - pair.max(axis=0))
            pair /= pair.sum(axis=0)
            truth = np.stack([1 - label[inner], 0 * a, 0 * a, label[inner]])
            grad[-4:] = ((pair - truth) * weight[inner]).sum(axis=1)
        grad += decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    q = np.clip(field.quality(x, size, n), 1e-4, 1 - 1e-4)
    field.slope, field.shift = logistic(np.log(q / (1 - q)), y.astype(np.float64))
    return field


def logistic(u: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(y) = sigmoid(a u + b), with a slight pull to a = 1, b = 0."""
    ab = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(ab[0] * u + ab[1])
        r = p - y
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * u).sum(), r.sum()]) + (ab - [1.0, 0.0])
        hess = np.array([[(w * u * u).sum() + 1, (w * u).sum()], [(w * u).sum(), w.sum() + 1]])
        ab = ab - np.clip(np.linalg.solve(hess, g), -2, 2)
    return float(ab[0]), float(ab[1])


def batch_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffers(texts)
    parts = [features(data, offsets[a : b + 1]) for a, b in row_blocks(offsets)]
    if not parts:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def fold(key: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, sample_total: int = SAMPLE_TOTAL, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """The field fitted on at most ``sample_docs`` labelled documents, taken in the order of a hash.

    Documents of more than ``sample_lines`` lines are left out of the sample, and so are
    those after the first ``sample_total`` lines of all: the driver gets no more. Null ids,
    labels other than 0 and 1, and labels without a document teach nothing; of several
    labels of one document one is used.
    """
    key = F.col(id_col).cast("string")
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    known = known.orderBy(F.md5(key), id_col).limit(sample_docs).withColumnRenamed(id_col, "_id")
    rows = docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("_id")).select("_id", "y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, n = batch_features(batch.column(2))
            at = np.cumsum(n) - n
            keep = np.flatnonzero(n <= sample_lines)
            blobs = [[a[at[i] : at[i] + n[i]].astype(np.float32).tobytes() for i in keep] for a in (x, size)]
            lines = pa.array(n[keep].astype(np.int64))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), lines, *(pa.array(b, pa.binary()) for b in blobs)], ["_id", "y", "n", "x", "size"])

    kind = labels.schema[id_col].dataType.simpleString()
    measured = checkpoint(rows.mapInArrow(lean(measure), f"_id {kind}, y int, n long, x binary, size binary").withColumn("at", F.concat(F.md5(F.col("_id").cast("string")), F.md5("x"))))
    so_far = F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # over sizes alone, of sample_docs documents
    last = measured.select("at", so_far.alias("lines")).where(F.col("lines") <= sample_total).agg(F.max("at")).first()[0]
    got = measured.where(F.col("at") <= F.lit(last)).orderBy("at").limit(sample_docs).collect() if last is not None else []
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, N_FEATURES)
    size = np.frombuffer(b"".join(r["size"] for r in got), np.float32)
    return fit(x, size, np.array([len(r["size"]) // 4 for r in got], np.int64), np.array([r.y for r in got]))


def score(docs: DataFrame, field: Field, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality added, from whole texts.

    Null and empty texts are one empty line. Extra columns are kept; one named like
    ``column`` is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(column)
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = docs.columns.index(text)
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, n = batch_features(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(field.score(x, size, n))], [*names, "score"])

    return docs.toDF(*names).mapInArrow(lean(run), f"{fields}, score double").toDF(*docs.columns, column)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    scored = score(docs.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False))), train(docs, labels))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
