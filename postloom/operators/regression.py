"""Least squares and logistic fits of many groups at once, from sums that Spark aggregates.

A group's rows are read once: means and covariances of all columns are one aggregation with partial sums, and every model is a
part of that matrix, solved by Cholesky in Arrow batches with a row for each group. Nothing but those rows leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.session import checkpoint
from postloom.sources.readers import lookup

#: A column whose variance, given those before it, is below this share of its own is a combination of them.
LEAST_PIVOT = 1e-10


def gram(rows: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """``by``, n, mean (y, then xs) and cov (upper triangle, row by row) over the rows in which all of them are known."""
    columns = [y, *xs]
    known = rows.select(*by, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns))).dropna(subset=[f"_{i}" for i in range(len(columns))])
    names = [f"_{i}" for i in range(len(columns))]
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.array(*map(F.avg, names)).alias("mean"), F.array(*pairs).alias("cov"))


def matrices(cov: np.ndarray, size: int) -> np.ndarray:
    """Full matrices from rows of upper triangles."""
    out = np.zeros((len(cov), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = out[:, j, i] = cov
    return out


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factors of a stack of matrices, and which columns count; a column that depends on those before it is left out."""
    size = a.shape[1]
    factor, used = np.zeros_like(a), np.ones(a.shape[:2], bool)
    for j in range(size):
        rest = a[:, j, j] - (factor[:, j, :j] ** 2).sum(1)
        used[:, j] = rest > LEAST_PIVOT * np.maximum(a[:, j, j], np.finfo(float).tiny)
        factor[:, j, j] = np.sqrt(np.where(used[:, j], rest, 1.0))
        factor[~used[:, j], j, :j] = 0
        below = a[:, j + 1 :, j] - (factor[:, j + 1 :, :j] * factor[:, None, j, :j]).sum(2)
        factor[:, j + 1 :, j] = np.where(used[:, j, None], below / factor[:, j, j, None], 0.0)
    return factor, used


def solved(factor: np.ndarray, used: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of (factor factor') x = right, 0 for columns left out; ``right`` is a stack of matrices."""
    x = np.where(used[:, :, None], right, 0.0)
    size = factor.shape[1]
    for j in range(size):
        x[:, j] = (x[:, j] - (factor[:, j, :j, None] * x[:, :j]).sum(1)) / factor[:, j, j, None]
    for j in reversed(range(size)):
        x[:, j] = (x[:, j] - (factor[:, j + 1 :, j, None] * x[:, j + 1 :]).sum(1)) / factor[:, j, j, None]
    return np.where(used[:, :, None], x, 0.0)


def _solve(mean: np.ndarray, cov: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes, intercepts, inverses of the regressors' covariance, and which regressors count, for each group."""
    within = cov[:, at][:, :, at]
    factor, used = cholesky(within)
    slopes = solved(factor, used, cov[:, at, 0][:, :, None])[:, :, 0]
    inverse = solved(factor, used, np.broadcast_to(np.eye(len(at)), within.shape).copy())
    return slopes, mean[:, 0] - (slopes * mean[:, at]).sum(1), inverse, used


def _sums(frame: pd.DataFrame, size: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = np.array(frame[f"{prefix}mean"].tolist(), float).reshape(-1, size)
    return frame[f"{prefix}n"].to_numpy(float), mean, matrices(np.array(frame[f"{prefix}cov"].tolist(), float).reshape(len(mean), -1), size)


def _fields(rows: DataFrame, by: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in by)


def least_squares(rows: DataFrame, y: str, models: dict[str, list[str]], by: list[str]) -> DataFrame:
    """``by``, model, term (``const`` first), coefficient, std_error, t, n, r2, adjusted_r2, rmse of each model in each group.

    All models are fitted to the rows in which y and every column of any model are known, in one pass. A column that is constant or a
    combination of those before it has a null coefficient and counts for nothing. Standard errors are null where no degree of
    freedom is left, r2 where y is constant. Groups without such rows have no rows here; a null in ``by`` is a group.
    """
    xs = list(dict.fromkeys(x for columns in models.values() for x in columns))
    sums = gram(rows, y, xs, by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, mean, cov = _sums(frame, len(xs) + 1)
            for name, columns in models.items():
                at = [1 + xs.index(c) for c in columns]
                slopes, const, inverse, used = _solve(mean, cov, at)
                total = cov[:, 0, 0]
                error = np.maximum(total - (slopes * cov[:, at, 0]).sum(1), 0.0)
                free = n - 1 - used.sum(1)
                with np.errstate(all="ignore"):
                    r2 = np.where(total > 0, 1 - error / total, np.nan)
                    variance = np.where(free > 0, error * n / free, np.nan)
                    spread = np.sqrt(variance[:, None] * np.einsum("gii->gi", inverse) / n[:, None])
                    level = np.sqrt(variance * (1 + np.einsum("gi,gij,gj->g", mean[:, at], inverse, mean[:, at])) / n)
                    fit = {"n": n.astype(np.int64), "r2": r2, "adjusted_r2": np.where(free > 0, 1 - (1 - r2) * (n - 1) / free, np.nan), "rmse": np.sqrt(error)}
                    for k, term in enumerate(["const", *columns]):
                        b, e = (const, level) if k == 0 else (np.where(used[:, k - 1], slopes[:, k - 1], np.nan), np.where(used[:, k - 1], spread[:, k - 1], np.nan))
                        yield pd.DataFrame({**{c: frame[c] for c in by}, "model": name, "term": term, "coefficient": b, "std_error": e, "t": np.where(e > 0, b / e, np.nan), **fit})

    return _null(sums.mapInPandas(run, _fields(sums, by) + "model string, term string, coefficient double, std_error double, t double, n long, r2 double, adjusted_r2 double, rmse double"))


def _null(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.nanvl(c, F.lit(None)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes))


def forecast(rows: DataFrame, y: str, models: dict[str, list[str]], by: list[str], training: Column, testing: Column) -> DataFrame:
    """``by``, model, n_train, n_test, rmse_train, rmse_test: each model fitted where ``training`` holds and measured where ``testing`` does.

    A row may be in both. One pass: errors on the test rows follow from their means and covariances too, so they are never joined with
    the fits. Rows with an unknown column take no part; a group without rows of either kind has no row.
    """
    xs = list(dict.fromkeys(x for columns in models.values() for x in columns))
    parts = F.filter(F.array(F.when(training, "train"), F.when(testing, "test")), lambda p: p.isNotNull())
    sums = gram(rows.withColumn("_part", F.explode(parts)), y, xs, [*by, "_part"])
    side = lambda p: [F.max(F.when(F.col("_part") == p, F.col(c))).alias(f"{p}_{c}") for c in ("n", "mean", "cov")]
    keys = by or [F.lit(1).alias("_all")]
    both = sums.groupBy(*keys).agg(*side("train"), *side("test")).filter("train_n IS NOT NULL AND test_n IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, mean, cov = _sums(frame, len(xs) + 1, "train_")
            n2, mean2, cov2 = _sums(frame, len(xs) + 1, "test_")
            for name, columns in models.items():
                at = [1 + xs.index(c) for c in columns]
                slopes, const, _, _ = _solve(mean, cov, at)
                inside = np.maximum(cov[:, 0, 0] - (slopes * cov[:, at, 0]).sum(1), 0.0)
                scatter = cov2[:, 0, 0] - 2 * (slopes * cov2[:, at, 0]).sum(1) + np.einsum("gi,gij,gj->g", slopes, cov2[:, at][:, :, at], slopes)
                bias = mean2[:, 0] - const - (slopes * mean2[:, at]).sum(1)
                yield pd.DataFrame({**{c: frame[c] for c in by}, "model": name, "n_train": n.astype(np.int64), "n_test": n2.astype(np.int64), "rmse_train": np.sqrt(inside), "rmse_test": np.sqrt(np.maximum(scatter, 0.0) + bias**2)})

    return both.mapInPandas(run, _fields(both, by) + "model string, n_train long, n_test long, rmse_train double, rmse_test double")


def predicted(rows: DataFrame, fits: DataFrame, xs: list[str], by: list[str], model: str, name: str = "predicted") -> DataFrame:
    """The rows with what one model of ``least_squares`` gives; null where a column is unknown or the group has no fit."""
    terms = fits.filter(F.col("model") == model).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("coefficient", F.lit(0.0))))).alias("_b"))  # a term for each column
    keys = [f"_k{i}" for i in range(len(by))]
    terms = terms.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), "_b")
    value = F.col("_b")["const"]
    for x in xs:
        value = value + F.col("_b")[x] * F.col(x).cast("double")
    if not by:
        return predicted(rows.withColumn("_all", F.lit(1)), fits.withColumn("_all", F.lit(1)), xs, ["_all"], model, name).drop("_all")
    return lookup(rows, terms, _same(by, keys), "left").withColumn(name, value).drop("_b", *keys)


def lagged(rows: DataFrame, by: list[str], order: str, column: str, n: int = 1, name: str | None = None) -> DataFrame:
    """The rows with the column's value ``n`` rows before in each group; series are short, one row a period."""
    return rows.withColumn(name or f"{column}_lag", F.lag(column, n).over(Window.partitionBy(*by).orderBy(order)))


#: Newton steps of a logistic fit, the greatest change of a standardised coefficient at the last, and the longest step.
STEPS, SETTLED, LONGEST = 40, 1e-9, 4.0


def logit(rows: DataFrame, y: str, xs: list[str], by: list[str], *, weight: str | None = None, steps: int = STEPS) -> DataFrame:
    """``by``, term (``const`` first), coefficient, std_error, z, n, log_likelihood, pseudo_r2 and converged of unpenalised logistic fits.

    y is 0 or 1. Columns are standardised by their own group. Every Newton step is one aggregation over all groups: sums of the
    gradient and the upper triangle of the second derivatives, solved by Cholesky in Arrow batches. Groups in which y is always the
    same, or no row is whole, have no rows; a column that is constant or a combination of others has a null coefficient. Where
    labels can be told apart without error no fit exists: ``converged`` is false and coefficients are null. A null in ``by`` is a group.
    A row counts ``weight`` times, a whole number above 0.
    """
    if not by:
        return logit(rows.withColumn("_all", F.lit(1)), y, xs, ["_all"], weight=weight, steps=steps).drop("_all")
    times = F.col(weight).cast("double") if weight else F.lit(1.0)
    whole = rows.select(*by, *(F.col(c).cast("double").alias(c) for c in [y, *xs]), times.alias("_times")).dropna(subset=[y, *xs, "_times"])
    size = len(xs) + 1
    counted = whole.groupBy(*(F.col(c).alias(f"_n{i}") for i, c in enumerate(by))).agg(F.sum("_times").cast("long").alias("n"), (F.sum(F.col("_times") * F.col(y)) / F.sum("_times")).alias("share"))
    sums = gram(whole, y, xs, by)
    start = sums.filter(F.col("mean")[0].between(1e-300, 1 - 1e-16)).withColumns({"b": F.concat(F.array(F.log(F.col("mean")[0] / (1 - F.col("mean")[0]))), F.array_repeat(F.lit(0.0), size - 1)), "change": F.lit(float("inf"))})
    diagonal = [sum(size - k for k in range(i)) for i in range(size)]  # places in the upper triangle
    sd = F.array(*(F.sqrt(F.col("cov")[d]) for d in diagonal[1:]))
    keys = [f"_k{i}" for i in range(len(by))]
    fits = start.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), "b", "change", "mean", sd.alias("sd"))
    names = [f"_z{i}" for i in range(size)]
    for _ in range(steps):
        joined = lookup(whole, fits.select(*keys, "b", "mean", "sd"), _same(by, keys))
        z = [F.lit(1.0), *(F.coalesce(F.try_divide(F.col(x) - F.col("mean")[i + 1], F.col("sd")[i]), F.lit(0.0)) for i, x in enumerate(xs))]
        parts = joined.select(*by, F.col(y).alias("_y"), "_times", "b", "mean", "sd", *(e.alias(n) for e, n in zip(z, names, strict=True)))
        eta = sum((F.col("b")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
        parts = parts.withColumn("_e", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_e")))).withColumn("_w", F.col("_times") * F.col("_p") * (1 - F.col("_p")))
        gradient = F.array(*(F.sum(F.col("_times") * (F.col("_y") - F.col("_p")) * F.col(n)) for n in names))
        second = F.array(*(F.sum(F.col("_w") * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]))
        # log(1 + exp(e)) without overflow
        likelihood = F.sum(F.col("_times") * (F.col("_y") * F.col("_e") - F.greatest(F.col("_e"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("_e")))))
        own = [F.first(c).alias(c) for c in ("b", "mean", "sd")]
        step = parts.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(*own, gradient.alias("g"), second.alias("h"), likelihood.alias("ll"))
        fits = checkpoint(_newton(step, size, len(by)))
        if fits.filter(F.col("change") > SETTLED).isEmpty():
            break
    return _logit_table(fits, counted, xs, by)


def _same(one: list[str], other: list[str]) -> Column:
    """Whether all pairs of columns are equal, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(one, other, strict=True)))


def _newton(sums: DataFrame, size: int, keys: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            b, g = (np.array(frame[c].tolist(), float).reshape(-1, size) for c in ("b", "g"))
            factor, used = cholesky(matrices(np.array(frame["h"].tolist(), float).reshape(len(b), -1), size))
            step = solved(factor, used, g[:, :, None])[:, :, 0]
            long = np.abs(step).max(1, keepdims=True) if len(b) else np.zeros((0, 1))
            step = step * np.minimum(1.0, LONGEST / np.maximum(long, 1e-300))
            out = frame.drop(columns=["g"]).copy()
            out["b"], out["change"] = list(b + step), np.abs(step).max(1) if len(b) else []
            yield out

    kinds = "".join(f"`{c}` {k}, " for c, k in sums.dtypes[:keys])
    return sums.mapInPandas(run, kinds + "b array<double>, mean array<double>, sd array<double>, h array<double>, ll double, change double")


def _logit_table(fits: DataFrame, counts: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    size = len(xs) + 1
    both = lookup(fits, counts, _same([f"_n{i}" for i in range(len(by))], [f"_k{i}" for i in range(len(by))])).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(by)), "b", "mean", "sd", "h", "ll", "change", "n", "share")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            b, mean = (np.array(frame[c].tolist(), float).reshape(-1, size) for c in ("b", "mean"))
            sd = np.array(frame["sd"].tolist(), float).reshape(-1, size - 1)
            factor, used = cholesky(matrices(np.array(frame["h"].tolist(), float).reshape(len(b), -1), size))
            inverse = solved(factor, used, np.broadcast_to(np.eye(size), (len(b), size, size)).copy())
            settled = frame["change"].to_numpy() <= SETTLED
            # back to the columns' own scale: const takes the means with it
            back = np.zeros((len(b), size, size))
            scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
            back[:, 0, 0] = 1
            back[:, 0, 1:] = -mean[:, 1:] * scale
            back[:, np.arange(1, size), np.arange(1, size)] = scale
            beta = np.einsum("gij,gj->gi", back, b)
            error = np.sqrt(np.maximum(np.einsum("gij,gjk,gik->gi", back, inverse, back), 0))
            n, share, ll = (frame[c].to_numpy(float) for c in ("n", "share", "ll"))
            null = n * (share * np.log(share) + (1 - share) * np.log1p(-share))
            for k, term in enumerate(["const", *xs]):
                ok = settled & used[:, k] & ((sd[:, k - 1] > 0) if k else True)
                value, spread = np.where(ok, beta[:, k], np.nan), np.where(ok, error[:, k], np.nan)
                with np.errstate(all="ignore"):
                    yield pd.DataFrame({**{c: frame[c] for c in by}, "term": term, "coefficient": value, "std_error": spread, "z": value / spread, "n": n.astype(np.int64), "log_likelihood": ll, "pseudo_r2": 1 - ll / null, "converged": settled})

    return _null(both.mapInPandas(run, _fields(both, by) + "term string, coefficient double, std_error double, z double, n long, log_likelihood double, pseudo_r2 double, converged boolean"))
