"""From raw documents to packed training sequences, in stages that each read what the one before wrote.

``run(spark, sf_dir)`` starts from the ``documents`` table; a stage is a function of the session, the documents so far and the
folder of tables. Stages are written as Parquet in a shared folder and read again, so each works on settled input. All but the
last return the columns of documents: others are left out, whatever their names. A stage of no rows returns none. Texts are
read whole. Repeated rows and ties are settled as each stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import decontaminate, jaccard, langid, packing, quality
from postloom.llm.base import ensure_checkpoint_dir

#: Columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best language needs less than this share fewer bits than the next can't be told and are rejected.
LEAST_CERTAINTY = 0.02


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, doesn't reject; null and empty ones are rejected.

    Repeated rows are decided alike; without labels to learn from, every text scores 0.5 and stays.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(_columns(docs), model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not ``und`` (null, empty or letterless text) and not between two languages.

    Repeated rows are decided alike; where no language can be learned, no document stays.
    """
    return langid.keep_certain(_columns(docs), langid.learn(docs), LEAST_CERTAINTY)


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents, and the hash of the text that tells rows of one id, or without id, apart."""
    return _columns(docs).withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group that near-duplicates connect: of the least id (null last), then of the least hash of the text.

    Rows are decided by id and text: another text of a kept id goes if it isn't kept itself, and of repeated rows one stays.
    Null, empty and blank texts are groups of their own, so one row of each id stays.
    """
    found = jaccard.near_duplicates(docs).filter("doc_id <=> class_id AND text_hash = class_hash")
    heads = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_head")).distinct()
    keyed = _keyed(docs)
    kept = keyed.join(heads, (F.col("_hash") == F.col("_head")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return _columns(kept.dropDuplicates(["doc_id", "_hash"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no item of the benchmark occurs; rows without id or of a shared id are decided by their own text.

    Null and empty texts hold nothing and stay.
    """
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_leak")).distinct()
    keyed = _keyed(docs)
    return _columns(keyed.join(leaks, (F.col("_hash") == F.col("_leak")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is one piece, its end."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("duplicates", duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Models, hashes and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote is removed when the next one is written, but for the last."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if written:
            _remove(spark, written)
        written = f"{folder}/{name}"
        docs = spark.read.parquet(written)
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
