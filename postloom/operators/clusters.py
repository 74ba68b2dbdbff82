"""K-means for several numbers of clusters at once: starts by k-means||, Lloyd steps, inertia and silhouette, from sums.

A pass over the vectors places each one for every number of clusters together, and each task hands on one sum for a cluster, so a
step is one scan. Starts are drawn by digests of the keys, so that a rerun draws the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import checkpoint

#: Rounds in which starts are drawn, and starts a round for each cluster; Lloyd steps at most, and the move of a centre that ends them.
DRAWS, PER_CLUSTER, STEPS, SETTLED = 5, 2, 50, 1e-9


def points_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key as long and x; rows whose vector is null, empty or holds null or non-finite entries are left out."""
    v = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    return v.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (ties to the first) and the squared distance."""
    gaps = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    at = gaps.argmin(1)
    return at, ((x - centres[at]) ** 2).sum(1)


def _cells(points: DataFrame, work: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """The sum over all tasks of an array of ``cells`` numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells)
        for frame in frames:
            if len(frame):
                total += work(np.stack(frame["x"].to_numpy())).ravel()
        yield pd.DataFrame({"cell": np.arange(cells), "value": total})

    out = np.zeros(cells)
    for r in points.select("x").mapInPandas(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # ``cells`` rows
        out[r.cell] = r.value
    return out


def starts(points: DataFrame, key: str, k: int) -> np.ndarray:
    """``k`` starts by k-means||: in each round a point is drawn with a chance that follows its squared distance from the points drawn before.

    The points drawn, some ``PER_CLUSTER * k`` a round, are weighted by how many are nearest to each, and k of them are chosen
    on the driver, each time the one that lowers the weighted cost most. There may be fewer than k different points.
    """
    spark = points.sparkSession
    first = points.orderBy(F.xxhash64(key), key).limit(1).collect()
    drawn = np.array([r.x for r in first], float)
    if not first:
        return drawn
    for step in range(DRAWS):
        cost = float(_cells(points, lambda x, c=drawn: np.array([_nearest(x, c)[1].sum()]), 1)[0])
        if cost <= 0:
            break
        sent = spark.sparkContext.broadcast((drawn, PER_CLUSTER * k / cost))

        def draw(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    known, rate = sent.value
                    far = _nearest(np.stack(frame["x"].to_numpy()), known)[1]
                    yield frame.loc[frame["u"].to_numpy() < rate * far, [key, "x"]]

        chance = F.pmod(F.xxhash64(F.lit(step), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
        more = points.withColumn("u", chance).mapInPandas(draw, f"{key} long, x array<double>").orderBy(key).collect()  # 2 k rows, about
        if more:
            drawn = np.unique(np.concatenate([drawn, np.array([r.x for r in more], float)]), axis=0)
    weight = _cells(points, lambda x: np.bincount(_nearest(x, drawn)[0], minlength=len(drawn)).astype(float), len(drawn))
    gaps = np.maximum((drawn**2).sum(1)[:, None] - 2 * drawn @ drawn.T + (drawn**2).sum(1), 0)
    chosen, least = [int(weight.argmax())], gaps[int(weight.argmax())].copy()
    while len(chosen) < min(k, len(drawn)):
        saved = (weight * np.maximum(least - gaps, 0)).sum(1)
        saved[chosen] = -1
        chosen.append(int(saved.argmax()))
        least = np.minimum(least, gaps[chosen[-1]])
    return drawn[chosen]


def lloyd(points: DataFrame, begun: dict[int, np.ndarray], steps: int = STEPS) -> dict[int, np.ndarray]:
    """Centres for every number of clusters, moved together until none moves any more; a centre without points stays."""
    now = {k: c.copy() for k, c in begun.items()}
    ks = list(now)
    for _ in range(steps):
        dim = now[ks[0]].shape[1]

        def sums(x: np.ndarray) -> np.ndarray:
            parts = []
            for k in ks:
                at, _ = _nearest(x, now[k])
                part = np.zeros((len(now[k]), dim + 1))
                np.add.at(part[:, :dim], at, x)
                part[:, dim] = np.bincount(at, minlength=len(now[k]))
                parts.append(part)
            return np.concatenate(parts)

        total = _cells(points, sums, sum(len(now[k]) for k in ks) * (dim + 1)).reshape(-1, dim + 1)
        moved, at = 0.0, 0
        for k in ks:
            own = total[at : at + len(now[k])]
            at += len(now[k])
            new = np.where(own[:, dim:] > 0, own[:, :dim] / np.maximum(own[:, dim:], 1), now[k])
            moved = max(moved, float(np.abs(new - now[k]).max()))
            now[k] = new
        if moved <= SETTLED:
            break
    return now


def quality(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[float, float]]:
    """inertia and mean silhouette (over squared distances) for every number of clusters, in two scans.

    The mean squared distance of a point from a cluster follows from the cluster's number, sum and sum of squared lengths. A point
    alone in its cluster has 0.
    """
    ks = list(centres)
    dim = centres[ks[0]].shape[1]

    def sums(x: np.ndarray) -> np.ndarray:
        parts = []
        for k in ks:
            at, gap = _nearest(x, centres[k])
            part = np.zeros((len(centres[k]), dim + 3))
            np.add.at(part[:, :dim], at, x)
            for column, value in ((dim, np.ones(len(x))), (dim + 1, (x**2).sum(1)), (dim + 2, gap)):
                part[:, column] = np.bincount(at, value, minlength=len(centres[k]))
            parts.append(part)
        return np.concatenate(parts)

    total = _cells(points, sums, sum(len(centres[k]) for k in ks) * (dim + 3)).reshape(-1, dim + 3)
    stats, at = {}, 0
    for k in ks:
        stats[k] = total[at : at + len(centres[k])]
        at += len(centres[k])

    def silhouettes(x: np.ndarray) -> np.ndarray:
        out = []
        for k in ks:
            own, _ = _nearest(x, centres[k])
            n, mean, squares = stats[k][:, dim], stats[k][:, :dim] / np.maximum(stats[k][:, dim:dim + 1], 1), stats[k][:, dim + 1] / np.maximum(stats[k][:, dim], 1)
            gaps = np.maximum((x**2).sum(1)[:, None] - 2 * x @ mean.T + squares, 0)
            rows = np.arange(len(x))
            inside = gaps[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
            other = np.where(n > 0, gaps, np.inf)
            other[rows, own] = np.inf
            near = other.min(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n[own] > 1) & np.isfinite(near) & (np.maximum(inside, near) > 0), (near - inside) / np.maximum(inside, near), 0.0)
            out.append(s.sum())
        return np.array(out)

    score = _cells(points, silhouettes, len(ks))
    return {k: (float(stats[k][:, dim + 2].sum()), float(score[i] / max(stats[k][:, dim].sum(), 1))) for i, k in enumerate(ks)}


def assigned(points: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """key and cluster, the number of the nearest centre."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({key: frame[key], "cluster": _nearest(np.stack(frame["x"].to_numpy()), centres)[0]})

    return points.mapInPandas(run, f"{key} long, cluster int")


def kmeans(rows: DataFrame, key: str, vector: str, ks: list[int], begun: dict[int, np.ndarray] | None = None) -> tuple[DataFrame, dict[int, np.ndarray], DataFrame]:
    """The points, the centres for each number of clusters, and the elbow table: k, clusters (different ones), inertia, silhouette.

    Rows without a whole vector take no part; all others have one length. No such rows: no centres and an empty table.
    """
    spark = rows.sparkSession
    points = checkpoint(points_of(rows, key, vector))
    schema = "k int, clusters int, inertia double, silhouette double"
    begun = begun or {k: starts(points, key, k) for k in ks}
    if not ks or not len(begun[ks[0]]):
        return points, {}, spark.createDataFrame([], schema)
    centres = lloyd(points, begun)
    found = quality(points, centres)
    return points, centres, spark.createDataFrame([(k, len(centres[k]), *found[k]) for k in ks], schema)


def mean_scores(placed: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """cluster, n, scored and mean of each cluster's scores."""
    return placed.join(scores.select(F.col(key).cast("long").alias(key), F.col(score).cast("double").alias("_s")), key, "left").groupBy("cluster").agg(F.count_distinct(key).alias("n"), F.count("_s").alias("scored"), F.avg("_s").alias("mean_score"))
