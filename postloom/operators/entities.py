"""Users, places and posts: latest rows, modes, anti-joins, unions and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, by: str, at: str, keep: str = "all") -> DataFrame:
    """Each key's rows of the greatest time: all of them, or one (the greatest struct of the other columns)."""
    if keep == "all":
        return rows.join(rows.groupBy(by).agg(F.max(at).alias("_last")), by).filter(F.col(at) == F.col("_last")).drop("_last")
    others = [c for c in rows.columns if c not in (by, at)]
    one = rows.groupBy(by).agg(F.max(F.struct(at, *others)).alias("_row"))
    return one.select(by, "_row.*")


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Each key's most frequent value and its count; ties go to the least value. Counted first, so a key's rows needn't meet."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return counts.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def without(rows: DataFrame, taken: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the taken sets: one anti-join with their union, not one for each."""
    return rows.join(reduce(DataFrame.unionByName, [t.select(key) for t in taken]), key, "left_anti")


def split(rows: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The chosen rows and the remainder."""
    return rows.join(chosen.select(key), key, "left_semi"), rows.join(chosen.select(key), key, "left_anti")


def wide_scores(scores: DataFrame, key: str, target: str, score: str, targets: list[str]) -> DataFrame:
    """One column of scores for each target, null where a key has none; no join for each target."""
    return scores.groupBy(key).pivot(target, targets).agg(F.max(score))


def dedupe(rows: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in the order given."""
    names = rows.columns
    keyed = rows.select("*", *(k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    grouped = [f"_k{i}" for i in range(len(keys))]
    return keyed.groupBy(*grouped).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select("_row.*")
