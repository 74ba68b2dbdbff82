import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from postloom.operators import fuzzy


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return row[-1]


def words(text):
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split())


def slow(a, b):
    x, y = words(a), words(b)
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(r))}".strip() for r in (x - y, y - x))
    ratio = lambda p, q: 2 * subsequence(p, q) / (len(p) + len(q)) if p and q else 0.0
    return 100 * max(ratio(both, one), ratio(both, two), ratio(one, two))


def texts(seed, n):
    rng = random.Random(seed)
    pool = ["new", "york", "paris", "san", "francisco", "st", "la", "city", "of", "é", "a", "texas", "tx", "usa"]
    out = ["", " ,", "New York", "york, NEW", "the new york city"]
    for _ in range(n):
        t = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        t = ["".join(c for c in w if rng.random() > 0.08) + ("x" if rng.random() < 0.08 else "") for w in t]
        out.append(rng.choice([" ", ", ", "-"]).join(t))
    return out


def test_subsequences():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc é😀") for _ in range(rng.randrange(90))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == subsequence(a, b)


def test_ratio_equals_a_slow_version(spark):
    pairs = list(zip(texts(1, 150), texts(2, 150), strict=True)) + [("abc", "abc"), ("a b", "b a"), ("fuzzy was a bear", "fuzzy fuzzy was a bear")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(slow(r.a, r.b)), (r.a, r.b)
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("r")).first().r is None


@pytest.mark.parametrize("threshold", [70.0, 80.0, 90.0, 100.0])
def test_join_finds_all_pairs(spark, threshold):
    one, two = texts(3, 120), texts(4, 120)
    left = spark.createDataFrame([(t,) for t in one] + [(None,)], "t string")
    right = spark.createDataFrame([(t, 1) for t in two], "u string, t int")
    got = {(r.left_key, r.right_key): r.ratio for r in fuzzy.similar_keys(left, right, "t", "u", threshold).collect()}
    key = lambda t: " ".join(sorted(words(t)))
    expected = {(key(a), key(b)): slow(a, b) for a, b in product(one, two) if words(a) and words(b) and slow(a, b) >= threshold - 1e-9}
    assert set(got) == set(expected) and len(expected) > 20
    for k, v in got.items():
        assert v == pytest.approx(expected[k])


def test_plan_has_no_all_pairs(spark):
    rows = spark.createDataFrame([("a b",)], "t string")
    plan = fuzzy.similar_keys(rows, rows, "t", "t", 90.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="threshold"):
        fuzzy.similar_keys(rows, rows, "t", "t", 50.0)
    assert fuzzy.similar_keys(rows.limit(0), rows, "t", "t", 90.0).count() == 0


def test_best_matches(spark):
    left = spark.createDataFrame([("new york",), ("nowhere",)], "t string")
    right = spark.createDataFrame([("new york city",), ("new york",), ("york",)], "t string")
    assert [tuple(r) for r in fuzzy.best_matches(left, right, "t", "t", 90.0).collect()] == [("new york", "city new york", 100.0)]
