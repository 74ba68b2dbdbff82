"""Bounded labelled samples for classifiers, and the split between learning and holding out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.base import crc_mod

#: Rows whose crc32(doc_id as text) modulo FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 5, 0
#: Documents of a sample by label, and the characters that a sample takes of one.
PER_LABEL, MAX_CHARS = 2500, 20_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that are held out; a null id is not, but is never learned from either."""
    return F.coalesce(crc_mod(id_col, FOLDS) == HELD_OUT, F.lit(False))


def prior(labels: DataFrame, label: str) -> float:
    """Share of label 1 among the labels that may be learned from; 0.5 if there are none."""
    row = labels.filter(F.col(label).isin(0, 1) & (crc_mod("doc_id", FOLDS) != HELD_OUT)).agg(F.avg(F.col(label).cast("double")).alias("p")).first()
    return 0.5 if row.p is None else float(row.p)


def least_by_hash(rows: DataFrame, by: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """``by`` and id of the ``most`` ids of each value of ``by`` whose hash is least.

    The values' numbers of ids, one row a value, tell which hashes can be among them, so only about twice as many are ranked.
    """
    hashed = rows.select(by, id_col, F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"))
    counts = hashed.groupBy(by).agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.least(F.lit(1.0), (2.0 * F.lit(most) + 64.0) / F.col("n"))
    near = hashed.join(F.broadcast(counts), by).filter(F.col("h") < share * float(1 << 30)).select(by, id_col, "h").distinct()  # counts: a row for each label or language
    order = Window.partitionBy(by).orderBy("h", id_col)
    return near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select(by, id_col)


def part(text: str, most: int) -> Column:
    """The text, or ``most`` characters of a longer one, at a place drawn by its hash."""
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - most + 1, F.lit(1)).cast("long")).cast("int")
    return F.when(F.length(text) <= most, F.col(text)).otherwise(F.substring(F.col(text), place + 1, F.lit(most)))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> pd.DataFrame:
    """text and y of at most ``per_label`` documents for each of labels 0 and 1, the smallest by a hash of the id.

    Of a document over ``max_chars`` a part of that length is taken. An id labelled both ways is left out, a repeated one
    counts once, with the least of its texts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (crc_mod("doc_id", FOLDS) != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("doc_id", "y")
    chosen = least_by_hash(known, "y", per_label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", part("text", max_chars).alias("text")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # chosen: 2 * per_label rows at most
    return found.toPandas().sort_values("doc_id", ignore_index=True)[["text", "y"]]
