"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target
over its source's size. Documents of a source stand in one order, by size class and then
by a hash; the running sum of expected copies, shifted by one random offset, gives a copy
at each integer that it crosses. The order by size class keeps the words taken near the
target as well as the copies.

Ranks within a source come from counts of cells (source, class, slice of the hash), so
that no task ever sorts more than one cell, however large its source is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
BROADCAST_ROWS = 100_000


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(docs[text], F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def in_turn(per_source: DataFrame) -> DataFrame:
    """Sources with their place, from 0, by code point with null last; no task sees more than a range of them."""
    placed = per_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # the lower 33 bits of this number count the rows of a partition
    placed = checkpoint(placed.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(parts), "part").withColumn("turn", F.col("before") + F.col("i")).drop("part", "i", "before")


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): column target added.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times
    all words; no target is over ``most`` times its source's size, and the excess is
    reshared by weight: words a unit of weight rise, round by round, as sources reach their
    cap, until no more do. Each round is one sum over all sources.
    """
    turns = F.array(*[F.lit(float(w)) for w in weights])
    s = in_turn(per_source)
    s = s.withColumn("weight", F.element_at(turns, F.pmod(F.col("turn"), F.lit(len(weights))).cast("int") + 1))
    s = checkpoint(s.withColumn("cap", F.col("source_size") * F.lit(float(most))))
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    left, free, full = 0.0, 1.0, -1
    while True:
        capped = F.col("cap") * F.lit(free) <= F.col("weight") * F.lit(left) if full >= 0 else F.lit(False)
        n, taken, open_ = s.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if n == full:
            break
        full, left, free = n, budget - (taken or 0.0), open_ or 0.0
    target = F.when(F.col("cap") * F.lit(free) <= F.col("weight") * F.lit(left), F.col("cap")).otherwise(F.col("weight") * F.lit(left) / F.lit(free or 1.0))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    cell_rows: int = 2_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of each document in the mix: (id, size, source_size, target, copies, taken).

    Each source has one random offset in [0, 1), drawn from ``seed``, so that reruns agree. Texts that
    are null or without words have size 0: they may be drawn but take no words. A null
    source is a source of its own, last in order. A null id is sampled like any other, its
    place within its class by its text.
    Equal rows are drawn as separate documents. Extra columns of ``docs`` are ignored,
    but those named in ``carry`` come along in a last column, the struct ``carried``. An empty
    table gives an empty result.
    """
    row = [F.struct(*carry).alias("carried")] if carry else []
    sized = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), sizes(docs, text).alias("size"), F.when(F.col(id_col).isNull(), F.col(text)).alias("text"), *row)
        .withColumn("class", size_class(F.col("size")))
        .withColumn("h", order_hash(F.coalesce(F.col("doc_id").cast("string"), "text"))).drop("text")
    )
    classes = sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = checkpoint(classes)
    goals = checkpoint(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    slices = classes.select("source", "class", F.ceil(F.col("n") / F.lit(float(cell_rows))).cast("long").alias("slices"))
    placed = look_up(sized, slices, "source", "class")
    placed = placed.withColumn("slice", F.floor(F.col("h") * F.col("slices") / F.lit(float(1 << 32))).cast("long"))
    cells = placed.groupBy("source", "class", "slice").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "class", "slice", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    cells = checkpoint(look_up(cells, goals, "source"))
    ranked = placed.withColumn("row", F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("h", "doc_id", "size", *([F.xxhash64("carried")] if carry else []))))
    ranked = look_up(ranked, cells, "source", "class", "slice")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("row")
    offset = order_hash(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))) / F.lit(float(1 << 32))
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    out = ranked.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["carried"] if carry else []))


def look_up(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Inner join of rows with a checkpointed table on keys of which null is a value; a table of BROADCAST_ROWS or less goes to all tasks."""
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    table = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [rows[k].eqNullSafe(table[f"_{k}"]) for k in keys]
    return rows.join(table, on, "inner").drop(*[f"_{k}" for k in keys])


def size_class(size: Column) -> Column:
    """Eight classes to each doubling of the size."""
    return F.floor(F.log2(size + 1.0) * 8.0).cast("int")


def order_hash(key: Column) -> Column:
    """32 bits that fix the order of documents within a class."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, "text" AS txt, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), ordered AS (
  SELECT *, CAST(floor(log2(size + 1.0) * 8.0) AS INT) AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), txt, '')), 1, 8) AS BIGINT) AS h,
    CAST('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift FROM sized
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((turn - 1) % 3) + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM per_source
), running AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM weighed
), flagged AS (SELECT *, (budget - capped) * weight >= cap * open AS is_full FROM running),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM flagged
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, h, doc_id, size) AS place FROM ordered
), drawn AS (
  SELECT r.doc_id, r.size, r.shift, g.source_size, g.target, r.place, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((floor(place * rate + shift) - floor((place - 1) * rate + shift)) AS BIGINT) * CAST(size AS BIGINT) AS taken
FROM drawn
"""
