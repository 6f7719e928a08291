"""Ingest: deduplication by identity, upserts, deletions and the list of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_batch(items: DataFrame) -> DataFrame:
    """One row of each hash: the one of the smallest id."""
    by = Window.partitionBy("hash").orderBy("id")
    return items.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def insert_new(batch: DataFrame, vault: DataFrame) -> DataFrame:
    """Rows of a batch whose hash the vault lacks, each hash once."""
    return first_of_batch(batch).join(vault.select("hash"), "hash", "left_anti")


def actions(batch: DataFrame, vault: DataFrame) -> DataFrame:
    """Rows (id, hash, action) of a batch: added, updated, duplicate or failed.

    ``batch`` has (id, hash, content, error); an error fails. A known hash with other
    content updates. Of equal new hashes in a batch the first is added and the others are
    judged against it.
    """
    first = Window.partitionBy("hash").orderBy("id")
    known = vault.groupBy("hash").agg(F.min_by("content", "id").alias("old"))
    b = batch.withColumn("ok", F.col("error").isNull())
    b = b.withColumn("rn", F.when(F.col("ok"), F.row_number().over(Window.partitionBy("hash", "ok").orderBy("id"))))
    b = b.withColumn("lead", F.first(F.when(F.col("ok"), F.col("content")), ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    b = b.join(known, "hash", "left")
    seen = F.coalesce("old", F.when(F.col("rn") > 1, F.col("lead")))
    action = F.when(~F.col("ok"), "failed").when(seen.isNull(), "added").when(seen != F.col("content"), "updated").otherwise("duplicate")
    return b.select("id", "hash", action.alias("action"))


def report(done: DataFrame) -> DataFrame:
    return done.groupBy("action").agg(F.count("*").alias("n"))


def merge(batch: DataFrame, vault: DataFrame) -> DataFrame:
    """The vault after an upsert: content and time of known hashes renewed, custom titles kept, new rows added."""
    fresh = first_of_batch(batch)
    new = fresh.select("hash", *[F.col(c).alias(f"new_{c}") for c in ("title", "content", "added_at")])
    old = vault.join(new, "hash", "left")
    changed = F.col("new_content").isNotNull() & (F.col("new_content") != F.col("content"))
    custom = F.coalesce(F.col("custom_title"), F.lit(False)) if "custom_title" in vault.columns else F.lit(False)
    kept = old.withColumn("title", F.when(changed & ~custom, F.col("new_title")).otherwise(F.col("title")))
    kept = kept.withColumn("added_at", F.when(changed, F.col("new_added_at")).otherwise(F.col("added_at"))).withColumn("content", F.when(changed, F.col("new_content")).otherwise(F.col("content")))
    return kept.select(*vault.columns).unionByName(fresh.join(vault.select("hash"), "hash", "left_anti"), allowMissingColumns=True).select(*vault.columns)


def delete(rows: DataFrame, tombstones: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of any derived table without those of deleted items."""
    return rows.join(tombstones.select(F.col("id").alias(key)), key, "left_anti")


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with all of an item replaced where fresh ones came."""
    return chunks.join(fresh.select("item_id").distinct(), "item_id", "left_anti").unionByName(fresh)


def backlog(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items without a title unit yet."""
    return items.join(chunks.where("ord = -1").select(F.col("item_id").alias("id")), "id", "left_anti")


def latest_failures(failed: DataFrame) -> DataFrame:
    """The last failure of each path; pasted texts, of an empty path, all stay."""
    by = Window.partitionBy("path", F.when(F.col("path") == "", F.col("id"))).orderBy(F.col("at").desc(), F.col("id").desc())
    return failed.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def still_failed(failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """The last failures that no later success of their path cleared."""
    last = succeeded.groupBy("path").agg(F.max("at").alias("ok_at"))
    return latest_failures(failed).join(last, "path", "left").where(F.col("ok_at").isNull() | (F.col("ok_at") < F.col("at"))).drop("ok_at")
