import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import regression


def slow(x, y):
    """Coefficients, standard errors, R2 and error by a general solver."""
    a = np.column_stack([np.ones(len(x)), x])
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ b
    free = len(y) - a.shape[1]
    spread = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (rest @ rest) / free) if free > 0 else [None] * a.shape[1]
    return b, spread, 1 - rest @ rest / ((y - y.mean()) @ (y - y.mean())), math.sqrt(rest @ rest / len(y))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for g in ("a", "b", None):
        for t in range(80):
            x1, x2 = rng.normal(1e3, 3), rng.normal(0, 1)
            out.append((g, t, x1, x2, 2 * x1 - x2, 7.0, 5 + 0.3 * x1 - 2 * x2 + rng.normal(0, 0.5)))
    out += [("a", 100, None, 1.0, 1.0, 7.0, 1.0), ("b", 101, 1.0, 1.0, 1.0, 7.0, None), ("empty", 1, None, None, None, None, None), ("one", 1, 1.0, 2.0, 3.0, 7.0, 4.0)]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, t int, x1 double, x2 double, both double, same double, y double")


def test_least_squares_equals_a_slow_fit(frame, rows):
    models = {"one": ["x1"], "two": ["x1", "x2"], "odd": ["x1", "x2", "both", "same"]}
    got = {(r.g, r.model, r.term): r for r in regression.least_squares(frame, "y", models, ["g"]).collect()}
    assert {k[0] for k in got} == {"a", "b", None, "one"}
    for g in ("a", "b", None):
        whole = np.array([r[2:] for r in rows if r[0] == g and None not in r[2:]], float)
        for name, at in (("one", [0]), ("two", [0, 1])):
            b, spread, r2, rmse = slow(whole[:, at], whole[:, 4])
            for k, term in enumerate(["const", *models[name]]):
                r = got[g, name, term]
                assert (r.coefficient, r.std_error, r.r2, r.rmse, r.n) == (pytest.approx(b[k], rel=1e-6), pytest.approx(spread[k], rel=1e-6), pytest.approx(r2, rel=1e-8), pytest.approx(rmse, rel=1e-8), len(whole))
                assert r.t == pytest.approx(b[k] / spread[k], rel=1e-6)
        # a column that others make, and a constant one, change nothing
        assert got[g, "odd", "both"].coefficient is None and got[g, "odd", "same"].coefficient is None
        assert got[g, "odd", "x2"].coefficient == pytest.approx(got[g, "two", "x2"].coefficient, rel=1e-6)
    alone = got["one", "two", "const"]
    assert (alone.coefficient, alone.std_error, alone.r2, alone.n) == (4.0, None, None, 1)


def test_forecast_equals_predictions_row_by_row(frame, rows):
    models = {"one": ["x1"], "two": ["x1", "x2"]}
    training, testing = F.col("t") <= 60, F.col("t") >= 60
    got = {(r.g, r.model): r for r in regression.forecast(frame, "y", models, ["g"], training, testing).collect()}
    assert {k[0] for k in got} == {"a", "b", None}
    fits = regression.least_squares(frame.filter(training), "y", models, ["g"])
    by_row = regression.predicted(frame, fits, ["x1", "x2"], ["g"], "two").filter(testing & F.col("predicted").isNotNull()).groupBy("g").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("predicted"), 2))).alias("e"), F.count("y").alias("n")).collect()
    for r in by_row:
        if r.g in ("a", "b", None):
            assert got[r.g, "two"].rmse_test == pytest.approx(r.e, rel=1e-6)
            assert (got[r.g, "two"].n_train, got[r.g, "two"].n_test) == (61, r.n)
    assert got["a", "two"].rmse_test < got["a", "one"].rmse_test
    whole = regression.forecast(frame, "y", models, [], training, testing).collect()
    assert [r.model for r in whole] == ["one", "two"]
    assert regression.forecast(frame.limit(0), "y", models, ["g"], training, testing).count() == 0


def newton(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        h = a.T @ (a * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, a.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h))), float(y @ np.log(p) + (1 - y) @ np.log(1 - p))


def test_logit_equals_a_slow_fit(spark):
    rng = np.random.default_rng(1)
    data = []
    for g, slope in (("a", 1.0), (None, -2.0)):
        for _ in range(400):
            x1, x2 = rng.normal(50, 4), rng.normal(0, 1)
            data.append((g, x1, x2, 3.0, int(rng.random() < 1 / (1 + math.exp(-(slope * (x1 - 50) / 4 + 0.5 * x2))))))
    data += [("apart", float(i), 0.5 * i * i, 3.0, int(i > 10)) for i in range(20)] + [("one kind", float(i), 1.0, 3.0, 1) for i in range(20)] + [("a", None, 1.0, 3.0, 1)]
    df = spark.createDataFrame(data, "g string, x1 double, x2 double, same double, y int")
    got = {(r.g, r.term): r for r in regression.logit(df, "y", ["x1", "x2", "same"], ["g"]).collect()}
    assert {k[0] for k in got} == {"a", None, "apart"}
    for g in ("a", None):
        whole = np.array([r[1:] for r in data if r[0] == g and r[1] is not None], float)
        b, spread, ll = newton(whole[:, :2], whole[:, 3])
        for k, term in enumerate(("const", "x1", "x2")):
            r = got[g, term]
            assert (r.coefficient, r.std_error, r.log_likelihood, r.n, r.converged) == (pytest.approx(b[k], rel=1e-6), pytest.approx(spread[k], rel=1e-5), pytest.approx(ll, rel=1e-9), len(whole), True)
        assert got[g, "same"].coefficient is None and 0 < got[g, "x1"].pseudo_r2 < 1
    assert not got["apart", "x1"].converged and got["apart", "x1"].coefficient is None
    assert regression.logit(df.filter("g = 'a'"), "y", ["x1"], []).count() == 2
    assert regression.logit(df.limit(0), "y", ["x1"], ["g"]).count() == 0
