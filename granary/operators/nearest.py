"""Exact nearest chunks by products of blocks.

What was typed is a small matrix that every task holds; a task multiplies its chunks with
it a block at a time and keeps the best of each query, so that a partition hands on no more
rows than were asked for, whatever its size. A last step merges those few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS, BLOCK_QUERIES = 9, 256


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column that are there, as a matrix of doubles for each length: (row numbers, matrix)."""
    sizes = np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy()), 0)
    flat, begin = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    return [(rows, flat[begin[rows][:, None] + np.arange(d)]) for d in np.unique(sizes[sizes > 0]) for rows in [np.flatnonzero(sizes == d)]]


def best(query: np.ndarray, chunk: np.ndarray, item: np.ndarray, ordinal: np.ndarray, cos: np.ndarray, limit: int | None, by_item: bool) -> np.ndarray:
    """Rows of the best ``limit`` chunks of each query, ties to the smaller one, or of its best items at their best chunks, ties to the smaller item."""
    order = np.lexsort((chunk, -cos, query))
    if by_item:
        _, first = np.unique(np.stack([query[order], item[order]]), axis=1, return_index=True)
        order = order[first]
        order = order[np.lexsort((item[order], -cos[order], query[order]))]
    if limit is None:
        return order
    q = query[order]
    begin = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    turn = np.arange(len(q)) - np.repeat(begin, np.diff([*begin, len(q)]))
    return order[turn < limit]


def products(queries: pa.Table, limit: int | None, floor: float, by_item: bool):
    """mapInArrow: chunks (chunk_id, item_id, ord, vec) to the best rows (query_id, chunk_id, item_id, ord, cos) of a partition."""
    ids = queries.column("query_id").to_numpy()
    asked = {x.shape[1]: (ids[rows], x) for rows, x in matrices(queries.column("vec").combine_chunks())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "chunk_id", "item_id", "ord", "cos"]
        kept: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.float64)]
        for batch in batches:
            chunk, item, ordinal = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for rows, x in matrices(batch.column(3)):
                if x.shape[1] not in asked:
                    continue
                query, y = asked[x.shape[1]]
                for a in range(0, len(query), BLOCK_QUERIES):
                    cos = np.round(y[a : a + BLOCK_QUERIES] @ x.T, DIGITS)
                    at, col = np.nonzero(cos >= floor)
                    new = [query[a + at], chunk[rows[col]], item[rows[col]], ordinal[rows[col]], cos[at, col]]
                    if limit is not None:
                        new = [np.concatenate(pair) for pair in zip(kept, new, strict=True)]
                    some = best(*new, limit, by_item) if limit is not None else np.arange(len(at))
                    new = [v[some] for v in new]
                    if limit is not None:
                        kept = new
                    elif len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in new], names)
        if limit is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in kept], names)

    return run


SCHEMA = "query_id long, chunk_id long, item_id long, ord int, cos double"


def all_pairs(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_id, item_id, ord, cos) of all chunks for each query; pairs of different lengths have none."""
    return cosine_rows(chunks, queries, None, -np.inf, False)


def cosine_rows(chunks: DataFrame, queries: DataFrame, limit: int | None, floor: float, by_item: bool) -> DataFrame:
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null").toArrow()
    rows = chunks.select(F.col("chunk_id").cast("long"), F.col("item_id").cast("long"), F.col("ord").cast("int"), "vec").where("vec is not null")
    return rows.mapInArrow(products(asked, limit, floor, by_item), SCHEMA)


def nearest(chunks: DataFrame, queries: DataFrame, limit: int, floor: float = -np.inf) -> DataFrame:
    """The ``limit`` nearest chunks of each query (query_id, vec) with cosine and rank, none under ``floor``; ties to the smaller id.

    ``chunks`` has (chunk_id, item_id, ord, vec) of unit vectors of any length; queries
    are what was typed. Cosines are rounded to nine digits. Null vectors take no part.
    """
    found = cosine_rows(chunks, queries, limit, float(floor), False)
    by = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < limit)


def nearest_items(chunks: DataFrame, queries: DataFrame, limit: int, floor: float = -np.inf) -> DataFrame:
    """The ``limit`` nearest items of each query, each at its nearest chunk, with cosine and rank; ties to the smaller item.

    An item among the best stands with its best chunk in some partition, among that
    partition's best items; so those are enough.
    """
    found = cosine_rows(chunks, queries, limit, float(floor), True)
    own = Window.partitionBy("query_id", "item_id").orderBy(F.col("cos").desc(), "chunk_id")
    one = found.withColumn("turn", F.row_number().over(own)).where("turn = 1").drop("turn")  # a few rows a query and partition
    by = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "item_id")
    return one.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < limit)
