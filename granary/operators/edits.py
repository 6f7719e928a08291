"""Edits of a vault's tables: notes, titles, cursors, stored copies, failures, stale texts.

Changes come as small tables keyed by id; each edit is one join and gives the whole table anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import preview
from granary.operators.ingest import latest_failures
from granary.operators.search import has_tags
from granary.plans.query import split_tags, strip_question


def changed(rows: DataFrame, changes: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """``rows`` with columns set where ``changes`` has their key; values may use its columns as ``new_...``."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key])
    both = rows.join(new, rows[key] == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    kept = [c for c in rows.columns if c not in values]
    return both.select(*[rows[c] for c in kept], *[F.when(hit, v).otherwise(rows[c] if c in rows.columns else F.lit(None)).alias(c) for c, v in values.items()]).select(*rows.columns, *[c for c in values if c not in rows.columns])


def _named(items: DataFrame) -> DataFrame:
    return items if "custom_title" in items.columns else items.withColumn("custom_title", F.lit(False))


def update_contents(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with new contents (id, content); titles and times stay."""
    return changed(items, changes, {"content": F.col("new_content")})


def update_notes(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes rewritten by edits (id, title, content, at): the title only where the user gave none."""
    title = F.when(F.coalesce("custom_title", F.lit(False)), F.col("title")).otherwise(F.col("new_title"))
    return changed(_named(items), edits, {"title": title, "content": F.col("new_content"), "added_at": F.col("new_at")})


def name_notes(items: DataFrame, names: DataFrame) -> DataFrame:
    """Notes named by (id, title); a blank name goes back to titles taken from the text."""
    given = F.trim("new_title") != ""
    return changed(_named(items), names, {"title": F.when(given, F.trim("new_title")).otherwise(F.col("title")), "custom_title": given})


def set_cursors(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """Items with the place of the cursor (id, row, col) as "row,col"."""
    return changed(items, cursors, {"cursor": F.concat_ws(",", F.col("new_row").cast("string"), F.col("new_col").cast("string"))})


def cursor_of(cursor: Column) -> Column:
    """struct<row, col> of a kept cursor; null where it is none."""
    part = lambda k: F.regexp_extract(cursor, r"^([+-]?\d+),([+-]?\d+)$", k).cast("long")
    return F.when(cursor.rlike(r"^[+-]?\d+,[+-]?\d+$"), F.struct(part(1).alias("row"), part(2).alias("col")))


def set_stored(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items with the path of their own copy (id, stored)."""
    return changed(items, stored, {"stored": F.col("new_stored")})


def new_notes(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items with an empty note for each row (id, at): its hash is of its time and id, so that no two are one."""
    hashed = F.concat(F.lit("note:"), F.col("at").cast("string"), F.lit(":"), F.col("id").cast("string"))
    made = wanted.select("id", F.lit("Untitled note").alias("title"), F.lit("note").alias("kind"), F.lit("").alias("content"), hashed.alias("hash"), F.col("at").alias("added_at"), F.array().cast("array<string>").alias("tags"))
    return items.unionByName(made.join(items.select("hash"), "hash", "left_anti"), allowMissingColumns=True).select(*items.columns)


# ---------------------------------------------------------------- failures


def record_failures(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """The list of failures after more of them: one for each path, the last; pasted texts are added."""
    return latest_failures(kept.unionByName(fresh))


def dismiss(failures: DataFrame, ids: DataFrame) -> DataFrame:
    return failures.join(ids.select("id"), "id", "left_anti")


def newest_failures(failures: DataFrame, limit: int) -> DataFrame:
    return failures.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def retried(failures: DataFrame) -> DataFrame:
    """Paths to be read again, each once; what was pasted has none and must be pasted anew."""
    return failures.where("path <> ''").select("path").distinct()


# ---------------------------------------------------------------- stale texts


def stale_items(items: DataFrame, stamp: int, current: int) -> DataFrame:
    """Items whose files are to be read again: PDFs and images with a source, where the text pipeline has changed."""
    return items.where(F.lit(stamp < current) & F.col("kind").isin("pdf", "image") & F.col("source").isNotNull()).select("id", "source")


def reread(items: DataFrame, stale: DataFrame, extracted: DataFrame) -> DataFrame:
    """Items with texts read again (path, content, error); files that are gone or unreadable keep theirs."""
    good = extracted.where("error is null").select(F.col("path").alias("source"), "content")
    return update_contents(items, stale.join(good, "source").select("id", "content"))


# ---------------------------------------------------------------- lists and lookups


def filter_notes(notes: DataFrame, query: str) -> DataFrame:
    """Notes that have all tags of a query and its words, as one text, in their title or preview; a question filters nothing but tags."""
    asks, _ = strip_question(query)
    tags, rest = split_tags(query)
    words = "" if asks else rest.strip().lower()
    met = F.contains(F.lower("title"), F.lit(words)) | F.contains(F.lower(preview(F.col("content"), 160)), F.lit(words))
    return notes.where(has_tags(tags) & (F.lit(words == "") | met))


def keep_order(hits: DataFrame, before: list[int], key: str = "item_id", rank: str = "rank") -> DataFrame:
    """Hits with a new rank: those of a list shown before in its order, then the others in theirs."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*[F.lit(int(i)) for i in before]).cast("array<bigint>"), F.col(key).cast("long")) if before else F.lit(0)
    order = Window.orderBy(F.when(place > 0, place).asc_nulls_last(), F.col(rank))
    return hits.withColumn(rank, F.row_number().over(order) - 1)


def look_up(items: DataFrame, most_bytes: int) -> DataFrame:
    """Rows (hash, id, title, tags, content) for lookups by hash; contents over ``most_bytes`` bytes are null."""
    return items.select("hash", "id", "title", "tags", F.when(F.octet_length("content") <= most_bytes, F.col("content")).alias("content"))
