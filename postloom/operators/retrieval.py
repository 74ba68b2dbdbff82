"""Ranks, top-k, and samples that a rerun repeats."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.session import checkpoint

#: Rows that a task draws at once, about, where rows are made up.
RANGE_ROWS = 1_000_000
#: Bits of a row's place within its partition in ``monotonically_increasing_id``.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rank``: a row number over all rows in an order, without one task for all rows and without a window.

    Rows are dealt to range partitions by the whole order and sorted there, so one value of its first column may fill many
    partitions; rows equal in all of it are dealt at random. Each is numbered by its place, and the sizes of the partitions before are
    added. The dealt rows are written once, as bounds drawn anew would give other numbers; the plan doesn't grow with the rows.
    """
    order = [*order, F.rand(7)]
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    placed = checkpoint(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1) + 1 + F.col("_above")).drop("_part", "_id", "_above")


def ranked(rows: DataFrame, score: str, tie: str, ranges: int | None = None) -> DataFrame:
    """A row number over all rows by falling score (null last), ties by rising ``tie``."""
    return numbered(rows, [F.desc_nulls_last(score), F.col(tie).asc()], ranges)


def dense_ranked(rows: DataFrame, score: str, ranges: int | None = None) -> DataFrame:
    """Dense rank by falling score: distinct scores are numbered, then joined back."""
    numbers = ranked(rows.select(score).distinct(), score, score, ranges).withColumnRenamed("rank", "dense_rank")
    return rows.join(numbers, score)


def around(rows: DataFrame, score: str, tie: str, threshold: float, n: int) -> DataFrame:
    """The n/2 rows just above and the n/2 just below a threshold, strictly."""
    high = rows.filter(F.col(score) > threshold).orderBy(score, tie).limit(n // 2)
    low = rows.filter(F.col(score) < threshold).orderBy(F.desc(score), tie).limit(n // 2)
    return high.unionByName(low)


def log_ranks(n: int = 10, magnitudes: int = 6) -> list[int]:
    """Ranks 1 to n, then the n ranks behind each of log-spaced points: i + 1 points, ends included, from 10**i to 10**(i + 1).

    Points are cut down to whole numbers.
    """
    exponents = {0.0} | {i + k / i for i in range(1, magnitudes) for k in range(i + 1)}
    points = {math.floor(10**e + 1e-6) for e in exponents}
    return sorted(set(range(1, n + 1)) | {p + k for p in points - {1} for k in range(1, n + 1)})


def spaced_ranks(first: int = 1, last: int = 6, points: int = 11, around: int = 10) -> list[int]:
    """The ``around`` ranks up to each point and the ``around`` ranks behind it, less one place; points are log-spaced from 10**first to 10**last."""
    step = (last - first) / (points - 1)
    at = {math.floor(10 ** (first + k * step) + 1e-6) for k in range(points)}
    return sorted({p + k for p in at for k in range(1 - around, around + 1)})


def on_steps(rank: Column, magnitude: int = 2, top: int = 100_000_000, n: int = 10) -> Column:
    """Whether a rank is one of the first ``n``, of the ``n`` up to a lower power of ten, or of the ``n`` up to a multiple of 10**magnitude no greater than ``top``."""
    size = 10**magnitude
    lower = reduce(lambda a, b: a | b, (rank.between(10**m - n + 1, 10**m) for m in range(2, magnitude)), rank <= n)
    return lower | (((rank - 1) % size >= size - n) & (rank <= top - top % size))


def hash_order(key: Column) -> Column:
    """An order that looks random, for keys of any size, and that any engine can repeat: the digest of the key as text."""
    return F.md5(key.cast("string").cast("binary"))


def hash_place(key: Column, places: int) -> Column:
    """A place from 0 that looks random, by 60 bits of the key's digest."""
    return F.conv(F.substring(hash_order(key), 1, 15), 16, 10).cast("long") % F.lit(places)


def per_group(rows: DataFrame, by: str, n: int, order: list[Column | str]) -> DataFrame:
    """Exactly n rows of each group (all, if fewer), first in the order; Spark keeps n a group before it shuffles."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def fraction_sample(rows: DataFrame, key: str, fractions: dict | float, by: str | None = None, steps: int = 1000) -> DataFrame:
    """Rows whose hashed key is below the fraction (of their group): the same rows in every run and partitioning."""
    place = hash_place(F.col(key), steps)
    if by is None:
        return rows.filter(place < int(fractions * steps))
    limit = F.lit(0)
    for value, fraction in fractions.items():
        limit = F.when(F.col(by) == value, F.lit(int(fraction * steps))).otherwise(limit)
    return rows.filter(place < limit)


def greedy_motifs(motifs: DataFrame, most: int = 5, look: int = 500) -> list[str]:
    """Motifs (motif, lift) by falling lift, none of which shares a token with one taken before or repeats one.

    The choice is a chain of decisions, made on the driver over ``look`` motifs at a time; motifs that share a token with
    one taken are left out before the next ones are brought.
    """
    taken: list[str] = []
    used: set[str] = set()
    rest = motifs
    while True:
        found = rest.orderBy(F.desc("lift"), "motif").limit(look).collect()
        for row in found:
            tokens = row.motif.split(" ")
            if len(set(tokens)) == len(tokens) and not used & set(tokens):
                taken.append(row.motif)
                used |= set(tokens)
            if len(taken) == most:
                return taken
        if len(found) < look:
            return taken
        last, tokens = found[-1], F.split("motif", " ")
        behind = F.col("lift").eqNullSafe(F.lit(last.lift)) & (F.col("motif") > last.motif)
        if last.lift is not None:
            behind |= F.col("lift").isNull() | (F.col("lift") < last.lift)
        free = ~F.arrays_overlap(tokens, F.array(*map(F.lit, sorted(used))).cast("array<string>")) & (F.size(F.array_distinct(tokens)) == F.size(tokens))
        rest = motifs.filter(behind & free)
