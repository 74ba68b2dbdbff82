import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import clusters, evaluation, ml


def blobs(seed=0, n=60, dim=5, k=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=4, size=(k, dim))
    return np.concatenate([c + rng.normal(size=(n, dim)) for c in centres])


def slow(x, start, steps=50):
    c = start.copy()
    for _ in range(steps):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    gaps = ((x[:, None] - x) ** 2).sum(2)
    s = []
    for i in range(len(x)):
        own = at == at[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        inside = gaps[i, own].sum() / (own.sum() - 1)
        near = min(gaps[i, at == j].mean() for j in range(len(c)) if j != at[i] and (at == j).any())
        s.append((near - inside) / max(near, inside))
    return c, at, float(((x - c[at]) ** 2).sum()), float(np.mean(s))


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(extra), "id long, v array<double>")


def test_elbow_equals_a_slow_version_on_fixed_starts(spark):
    x = blobs()
    begun = {k: x[: 7 * k : 7].copy() for k in (2, 3, 5)}
    points, centres, elbow = clusters.kmeans(frame(spark, x, [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0])]), "id", "v", [2, 3, 5], begun)
    got = {r.k: r for r in elbow.collect()}
    for k, start in begun.items():
        c, at, inertia, silhouette = slow(x, start)
        np.testing.assert_allclose(centres[k], c, atol=1e-8)
        assert (got[k].inertia, got[k].silhouette, got[k].clusters) == (pytest.approx(inertia), pytest.approx(silhouette), k)
        placed = {r.id: r.cluster for r in clusters.assigned(points, "id", centres[k]).collect()}
        assert placed == dict(enumerate(at.tolist()))


def test_starts_find_the_clusters_and_are_the_same_again(spark):
    x = blobs(1)
    one, two = (clusters.kmeans(frame(spark, x).repartition(n), "id", "v", [4]) for n in (2, 5))
    np.testing.assert_allclose(np.sort(one[1][4], 0), np.sort(two[1][4], 0), atol=1e-8)
    best = min(slow(x, x[np.random.default_rng(s).choice(len(x), 4, replace=False)])[2] for s in range(8))
    assert one[2].first().inertia <= best * 1.01


def test_few_points_and_mean_scores(spark):
    points, centres, elbow = clusters.kmeans(frame(spark, np.ones((6, 2))), "id", "v", [3])
    assert len(centres[3]) == 1 and elbow.first().inertia == 0 and elbow.first().silhouette == 0
    assert clusters.kmeans(frame(spark, np.ones((1, 2))).limit(0), "id", "v", [3])[2].count() == 0
    placed = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, cluster int")
    scores = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, None)], "id long, s double")
    assert sorted(map(tuple, clusters.mean_scores(placed, scores, "id", "s").collect())) == [(0, 2, 2, 0.5), (1, 1, 0, None)]


def pairs(s, y):
    p, n = s[y == 1], s[y == 0]
    return float(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean()) if len(p) and len(n) else None


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    g = rng.choice(["a", "b", "only"], 900)
    s, y = rng.integers(0, 40, 900) / 7, rng.integers(0, 2, 900)
    y[g == "only"] = 1
    rows = [(str(a) if a != "b" else None, float(b), int(c)) for a, b, c in zip(g, s, y, strict=True)] + [("a", None, 1), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    for n in (1, 6):
        got = {r.g: (r.n_pos, r.n_neg, r.auc) for r in evaluation.auc(df.repartition(n), "s", "y", ["g"]).collect()}
        for name in ("a", "b", "only"):
            k = g == name
            want = pairs(s[k], y[k])
            assert got[None if name == "b" else name] == (int(y[k].sum()), int((1 - y[k]).sum()), want if want is None else pytest.approx(want))
    assert evaluation.auc(df, "s", "y", []).first().auc == pytest.approx(pairs(s, y))
    assert evaluation.auc(df.limit(0), "s", "y", ["g"]).count() == 0


def test_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (None, 1)], "y int, p int")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in evaluation.report(df, "y", "p", []).collect()}
    assert got == {0: (0.5, 0.5, 0.5, 2), 1: (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), 3)}


def test_bootstrap_fits_equal_slow_ones(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    rows = [(i, float(v), int(k)) for i, (v, k) in enumerate(zip(rng.normal(size=200) + y, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    fits = {r["round"]: (r.slope, r.intercept) for r in evaluation.bootstrap_platt(df, "id", "s", "y", 12).collect()}
    drawn = evaluation.bootstrap_draws(df.select("id", F.col("s").alias("score"), F.col("y").alias("label")), "id", "label", 12).collect()
    assert set(fits) == set(range(1, 13))
    for k, (slope, intercept) in fits.items():
        x = np.array([(r.score, r.label) for r in drawn if r["round"] == k], float)
        a, b = np.column_stack([x[:, 0], np.ones(len(x))]), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ b))
            b = b + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]), a.T @ (x[:, 1] - p))
        assert (slope, intercept) == (pytest.approx(b[0], rel=1e-6), pytest.approx(b[1], rel=1e-6))
    r = evaluation.intervals(spark.createDataFrame([("a", float(i), -float(i)) for i in range(101)] + [("a", None, None)], "g string, slope double, intercept double"), ["g"], ["slope", "intercept"]).first()
    assert (r.fitted, r.slope, r.slope_low, r.slope_high, r.intercept_low) == pytest.approx((101, 50.0, 2.5, 97.5, -97.5))


def test_pattern_model_scores(spark):
    """A weighted fit by a slow Newton method with the same penalty gives the same scores."""
    rng = np.random.default_rng(4)
    rows = [(i, ("!! " if rng.random() < 0.3 + 0.4 * (i % 3 == 0) else "") + ("## " if rng.random() < 0.4 else "") + "text", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, None)], "id long, text string, y int")
    patterns = ["!!", "##"]
    scored = {r.id: r.score for r in ml.pattern_scores(df, ml.pattern_model(df, patterns, "text", "y", 0.01), patterns, "text").collect()}
    x = np.array([[p in t for p in patterns] for _, t, _ in rows], float)
    y = np.array([r[2] for r in rows], float)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = w / w.sum()
    sd = np.sqrt(np.average((x - np.average(x, 0, w)) ** 2, 0, w) * len(x) / (len(x) - 1))
    a, b = np.column_stack([x / sd, np.ones(len(x))]), np.zeros(3)
    penalty = np.diag([0.01, 0.01, 0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + penalty, a.T @ (w * (y - p)) - penalty @ b)
    want = 1 / (1 + np.exp(-a @ b))
    assert max(abs(scored[i] - v) for i, v in enumerate(want)) < 1e-3
    one = df.filter("y = 1")
    assert {r.score for r in ml.pattern_scores(one, ml.pattern_model(one, patterns, "text", "y"), patterns, "text").collect()} == {1.0}


def test_trained_classifier_is_chosen_by_its_held_out_area(spark):
    """The area that training returns is the best model's exact area on the held-out fifth, and the stronger signal's is higher."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"] if i % 2 else ["blue", "black", "white"], 6)) + (" good" if i % 2 and rng.random() < 0.5 else ""), i % 2) for i in range(400)] + [(900, "no label", None)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    model, area = ml.train_classifier(df, "text", "y", "id", features=256, strengths=(0.3, 0.01))
    held = df.filter("y IS NOT NULL").withColumn("y", F.col("y").cast("double")).filter(F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(held).select(F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("s"))
    assert area == pytest.approx(evaluation.auc(scored, "s", "y", []).first().auc, abs=0.01) and area > 0.95
    shuffled = df.withColumn("y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int"))
    assert ml.train_classifier(shuffled, "text", "y", "id", features=256, strengths=(0.3, 0.01))[1] < 0.8
