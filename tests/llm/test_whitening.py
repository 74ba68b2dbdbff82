import numpy as np
import pytest

from postloom.llm import queries, whitening

COLUMNS = "vec_id long, embedding array<float>, component string, n string"


def brute(rows, k=16):
    """vec_id, exact deviation and whitened values of each row by a dense covariance; and shares."""
    keep = [(i, np.floor(64 * np.array(v, np.float32).astype(float)) + 1_000_000) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in keep]), axis=0)
    n = len(fit)
    sums = [int(s) for s in fit.sum(0)]
    off = np.array([[n * int(x) - s for x, s in zip(row, sums, strict=True)] for row in fit], float) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values[:k] > 1e-11 * values[0]
    values_k, vectors_k = values[:k][real], vectors[:, :k][:, real]
    out = []
    for i, x in keep:
        d = [n * int(a) - s for a, s in zip(x, sums, strict=True)]
        out.append((i, sum(v * v for v in d), (np.array(d, float) / n) @ vectors_k / np.sqrt(values_k)))
    return n, values_k / values.sum(), out


def compare(df, rows):
    n, shares, expected = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    assert {r.n for g in got.values() for r in g} == {n}
    k = len(shares)
    white = []
    for i, deviation, values in expected:
        own = sorted(got[i, deviation], key=lambda r: r.component)[:: max(1, len(got[i, deviation]) // k)]
        assert [r.component for r in own] == list(range(1, k + 1))
        np.testing.assert_allclose([r.explained for r in own], shares, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in own)
        white.append(([r.whitened for r in own], values))
    signs = np.sign(sum(np.array(a) * b for a, b in white))
    for a, b in white:
        np.testing.assert_allclose(a, b * signs, atol=1e-8)
    assert sum(map(len, got.values())) == k * len(expected)


def vectors(n=400, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * np.linspace(3, 0.2, dim)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], COLUMNS)


def test_equals_a_dense_solution(spark):
    rows = vectors()
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a third are copies
    rows += [(2000, None), (2001, [*rows[0][1][:-1], None]), (2002, [float("nan"), *rows[0][1][1:]]), (2003, [float("inf"), *rows[0][1][1:]]), (2004, []), (None, rows[6][1])]
    compare(whitening.whiten(frame(spark, rows)), rows)


def test_few_vectors_and_constant_dimensions(spark):
    rows = [(i, [*v[:6], 0.5, 0.5]) for i, v in vectors(5)]
    compare(whitening.whiten(frame(spark, rows)), rows)


def test_large_entries_stay_exact(spark):
    rows = [(i, [c * 1e9 for c in v]) for i, v in vectors(50, 4)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: min(d, 2**63 - 1) for i, d, _ in brute(rows)[2]}
    off = np.array([[2**40, 3], [5, -(2**31)]], object)
    assert whitening.squares(off) == [2**80 + 9, 25 + 2**62]
    assert whitening.deviations(np.array([[2**61, 1]]), 10, [5, 7]).tolist() == [[10 * 2**61 - 5, 3]]


def test_other_lengths_one_vector_and_no_rows(spark):
    rows = vectors(30, 5)
    compare(whitening.whiten(frame(spark, [*rows, (99, [1.0, 2.0])])), rows)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0])]).limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "block", "basis", "rank"), [(64, 16, 256, 64), (300, 16, 96, 300), (120, 7, 60, 9), (20, 16, 256, 3)])
def test_lanczos_restarts_and_breakdowns(dim, block, basis, rank):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = np.zeros(dim)
    values[:rank] = np.sort(rng.random(rank) ** 2 + 0.01)[::-1]
    a = (q * values) @ q.T
    found, u, _ = whitening.leading(lambda x: a @ x, dim, 16, block=block, most_basis=basis)
    np.testing.assert_allclose(found, values[:16], atol=1e-12)
    np.testing.assert_allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-12)
    np.testing.assert_allclose(a @ u, u * found, atol=1e-11)


def test_query_over_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(queries.op11_embedding_whitening(spark, data), rows)
