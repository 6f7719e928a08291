"""Items of the engine from the supplied tables.

Ids of the kinds are set apart by fixed offsets; times are synthetic and follow the ids.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import item_hash, note_title, text_title

EPOCH = 1_700_000_000
WEB, NOTE, FILE = 10_000_000, 20_000_000, 30_000_000
COLUMNS = ("id", "title", "kind", "source", "content", "hash", "added_at", "tags")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of spark.checkpoint.dir. Where it is unset, one of this machine's, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="granary-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with files in the shared folder: for what a query reads several times."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores: its few row groups would keep most of them idle. Large ones stay as they are read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    kind = F.lit("text")
    return d.select(
        F.col("doc_id").alias("id"),
        text_title(F.col("text")).alias("title"),
        kind.alias("kind"),
        "source",
        F.coalesce("text", F.lit("")).alias("content"),
        item_hash(kind, F.col("source"), F.col("text")).alias("hash"),
        (F.lit(EPOCH) + F.col("doc_id")).alias("added_at"),
        F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note a conversation: its turns in order, a blank line between them."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    content = F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), "\n\n")
    made = turns.select((F.lit(NOTE) + F.col("conv_id")).alias("id"), content.alias("content"))
    return made.select(
        "id",
        note_title(F.col("content"), F.lit(EPOCH) + F.col("id")).alias("title"),
        F.lit("note").alias("kind"),
        F.lit(None).cast("string").alias("source"),
        "content",
        F.sha2(F.concat(F.lit("note:"), F.col("id").cast("string")), 256).alias("hash"),
        (F.lit(EPOCH) + F.col("id")).alias("added_at"),
        F.array(F.lit("chat")).alias("tags"),
    )


def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    name = F.concat(F.lit("item"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".txt").otherwise(".py"))
    return b.select(
        (F.lit(FILE) + F.col("item_id")).alias("id"),
        name.alias("title"),
        F.lit("file").alias("kind"),
        F.concat(F.lit("C:/bench/"), name).alias("source"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.sha2(F.concat(F.lit("file\0"), F.sha2(F.coalesce("text", F.lit("")), 256)), 256).alias("hash"),
        (F.lit(EPOCH + FILE) + F.col("item_id")).alias("added_at"),
        F.array().cast("array<string>").alias("tags"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved web pages: readable text below the address; the address is the identity."""
    from granary.sources.html import readable

    p = spread(table(spark, sf_dir, "pages")).withColumn("page", readable(F.col("html")))
    return p.select(
        (F.lit(WEB) + F.col("page_id")).alias("id"),
        F.coalesce("page.title", "url").alias("title"),
        F.lit("web").alias("kind"),
        F.col("url").alias("source"),
        F.concat("url", F.lit("\n\n"), "page.text").alias("content"),
        F.sha2(F.concat(F.lit("web\0"), F.sha2("url", 256)), 256).alias("hash"),
        (F.lit(EPOCH + WEB) + F.col("page_id")).alias("added_at"),
        F.array().cast("array<string>").alias("tags"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds that need no extractor."""
    return documents(spark, sf_dir).unionByName(notes(spark, sf_dir)).unionByName(benchmark_files(spark, sf_dir))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors of ten items: (chunk_id, item_id, ord, vec)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("item_id"), (F.row_number().over(order) - 2).alias("ord"), F.col("embedding").alias("vec"))


def failures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Failed ingests (id, path, title, error, at) and later successes (path, at), from the event stream."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("path"), "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("props").alias("error"))
    kind = F.col("event_type")
    bad = e.where(kind == "error").select("id", "path", F.concat(F.lit("upload of "), "path").alias("title"), "error", "at")
    return bad, e.where(kind != "error").select("path", "at")
