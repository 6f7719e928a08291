"""Literal search through an index of trigrams.

A text that contains a term has all of its trigrams, and so has its item. Of each term the
rarest few are looked up; texts of items that have them all are held against the term itself,
so what is found is exact. Terms under three characters have no trigram and are held against
every text. The index has no row for each occurrence: tasks pack the items of a gram, some
thousands of chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE, BUCKETS = 3, 64
#: Trigrams of a term that are looked up; the rest is left to the comparison.
RAREST = 4
#: Items that are sent to all tasks rather than have all texts shuffled; characters that a task packs at a time, about.
BROADCAST_ITEMS, PACKED = 200_000, 1 << 22
CODES = 0x110000
KEYS = ["item_id", "ord"]


@dataclass(frozen=True)
class Grams:
    """postings (gram, items, n, bucket), packed by tasks, and counts (gram, n): items, those of several tasks counted in each."""

    postings: DataFrame
    counts: DataFrame


def grams_of(text: Column) -> Column:
    """The different runs of three characters of a text in lower case."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - (SIZE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: low.substr(k, F.lit(SIZE))))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def packed(rows: pa.Table) -> pa.RecordBatch:
    """A row for each gram of rows (item_id, low), in order of grams: the items of which a text has it."""
    said = rows.column("low").to_pylist()
    coded = rows.column("item_id").combine_chunks().dictionary_encode()
    codes = np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(said)), [len(t) for t in said])
    there = np.zeros(CODES, bool)
    there[codes] = True
    alphabet, n = np.flatnonzero(there), max(1, len(coded.dictionary))
    at = (np.cumsum(there) - 1)[codes]
    whole = text[2:] == text[:-2]
    size = len(alphabet)
    key = (at[:-2][whole] * size + at[1:-1][whole]) * size + at[2:][whole]
    item = coded.indices.to_numpy()[text[:-2][whole]]
    # Gram and item in one number, unless the alphabet is too large for that.
    if size**3 < (1 << 63) // n:
        both = np.unique(key * n + item)
        key, item = both // n, both % n
    else:
        key, item = np.unique(np.stack([key, item]), axis=1)
    first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    letters = [chr(c) for c in alphabet.tolist()]
    grams = [letters[k // size // size] + letters[k // size % size] + letters[k % size] for k in key[first].tolist()]
    ends = np.r_[first, len(key)].astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(ends if len(first) else [0], pa.int32()), coded.dictionary.take(pa.array(item)))
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), items, pa.array(np.diff(ends) if len(first) else [], pa.int32())], ["gram", "items", "n"])


def postings(chunks: DataFrame) -> DataFrame:
    """The postings of chunks (item_id, ord, text), packed where the chunks are."""
    kind = chunks.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("low").nbytes
            if size >= PACKED:
                yield packed(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    low = chunks.where("item_id is not null and text is not null").select("item_id", F.lower("text").alias("low"))
    return low.mapInArrow(run, f"gram string, items array<{kind}>, n int").withColumn("bucket", bucket(F.col("gram")))


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("gram").agg(F.sum("n").alias("n"))


def of(chunks: DataFrame) -> Grams:
    found = postings(chunks)
    return Grams(found, _counts(found))


def write(chunks: DataFrame, path: str) -> None:
    """The index as Parquet, dealt into buckets by gram; buckets are evened out first, so that no frequent gram makes one large file."""
    dealt = postings(chunks).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
    dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.page.row.count.limit", 256).parquet(f"{path}/grams")
    _counts(chunks.sparkSession.read.parquet(f"{path}/grams")).write.mode("overwrite").parquet(f"{path}/counts")


def read(spark: SparkSession, path: str) -> Grams:
    return Grams(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/counts"))


def rarest(index: Grams, terms: DataFrame) -> DataFrame:
    """Rows (term, gram, n, bucket, need) of terms whose trigrams all occur: the rarest of each, how many items have it, and how many those are."""
    asked = terms.select("term", F.explode(grams_of(F.col("term"))).alias("gram"))
    counted = asked.join(index.counts.join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi"), "gram", "left")
    by = Window.partitionBy("term")
    placed = counted.withColumns({"turn": F.row_number().over(by.orderBy("n", "gram")), "all": F.count("*").over(by), "known": F.count("n").over(by)})
    return placed.where((F.col("all") == F.col("known")) & (F.col("turn") <= RAREST)).select("term", "gram", "n", bucket(F.col("gram")).alias("bucket"), F.least("all", F.lit(RAREST)).alias("need"))


def containing(index: Grams, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (term, item_id, ord) of chunks whose text, in lower case, contains a term.

    ``terms`` (term) is what was typed and small; terms are compared as they stand. Only
    buckets of grams that are looked up are read, and only the texts of items that have them all
    are compared.
    """
    each = terms.select("term").where(F.length("term") > 0).distinct()
    wanted = rarest(index, each.where(F.length("term") >= SIZE))
    few = wanted.toArrow()
    spark = chunks.sparkSession
    found = []
    if few.num_rows:
        asked = F.broadcast(spark.createDataFrame(few).select("term", "gram", "need"))
        met = index.postings.where(F.col("bucket").isin(few.column("bucket").unique().to_pylist())).join(asked, "gram")
        held = met.select("term", "need", "gram", F.explode("items").alias("item_id")).groupBy("term", "item_id").agg(F.countDistinct("gram").alias("have"), F.max("need").alias("need"))
        whole = held.where("have = need").select("term", "item_id")
        if sum(few.group_by("term").aggregate([("n", "min")]).column("n_min").to_pylist()) <= BROADCAST_ITEMS:
            whole = F.broadcast(whole)
        found.append(chunks.select(*KEYS, "text").join(whole, "item_id").where(F.contains(F.lower("text"), F.col("term"))).select("term", *KEYS))
    short = each.where(F.length("term") < SIZE)
    if not short.isEmpty():
        found.append(chunks.join(F.broadcast(short), F.contains(F.lower("text"), F.col("term"))).select("term", *KEYS))
    if not found:
        return chunks.select(F.lit("").alias("term"), *KEYS).limit(0)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def scanned(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """What ``containing`` finds, without an index: one pass over the texts, with what was typed as an expression."""
    typed = [r.term for r in terms.select("term").where(F.length("term") > 0).distinct().collect()]
    low = chunks.select(*KEYS, F.lower("text").alias("low"))
    return low.select(F.explode(F.filter(F.array(*[F.lit(t) for t in typed]).cast("array<string>"), lambda t: F.contains(F.col("low"), t))).alias("term"), *KEYS)
