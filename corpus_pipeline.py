"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept,
and gives documents again; the last gives packed pieces. Any column may hold nulls, an empty
table gives an empty one, and columns beside those of documents are ignored, whatever their
names. What else a stage does with nulls, blanks and repeats stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import shared_folder
from granary.llm.jaccard import keep_one
from granary.llm.mixing import mix_sources
from granary.llm.packing import pack
from granary.llm.quality import fold, score, train
from granary.llm.repeats import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects: those scored under 0.5.

    Null and empty texts are scored like others. Rows are judged one by one: repeated ones
    share their fate, and a null id matters only in that no label can meet it.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    return score(docs, train(docs, labels), column="_score").where(F.col("_score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group: five-word shingles, similarity of 0.8 or more.

    Texts without words are like nothing and stay. Unlike texts of one id stay each; of rows
    equal in id and text one stays. Rows with a null id all stay.
    """
    return keep_one(docs, width=5, percent=80).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that an earlier document has; drops documents of which nothing is left.

    Texts that lose nothing keep their white space. Rows with a null id, null or short texts
    lose nothing. Rows that repeat an id are no earlier documents to one another.
    """
    cut = remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights; copies keep their id.

    Copies are drawn row by row: documents with a null id take part like any other, and keep
    it, and repeated rows are drawn each. A null source is one of its own. Texts without words
    may stay or go: they weigh nothing.
    """
    drawn = mix_sources(docs, carry=COLUMNS).where("copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; ids holds the tokens of each piece.

    A null or empty text is its end alone. Repeated rows and rows with a null id are packed each.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("mixing sources", mixture),
    ("packing", packing),
]

#: The classifier and the packing can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again.

    The files go to the folder of spark.checkpoint.dir; those of a stage are deleted once the
    next is written, but for the last, which the result reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
