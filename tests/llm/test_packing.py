import random
import zlib
from collections import Counter

import numpy as np
import pytest

from postloom.llm import packing


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_plan_holds_every_piece_once(n):
    rng = random.Random(n)
    histogram = Counter(min(1024, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(n))
    plan = packing.plan_sequences(dict(histogram), rounds=60)
    got = Counter()
    for pattern, k in plan.items():
        assert sum(pattern) <= 1024 and k > 0
        for x in pattern:
            got[x] += k
    assert got == histogram
    least = -(-sum(x * k for x, k in histogram.items()) // 1024)
    assert sum(plan.values()) <= max(sum(packing.best_fit(dict(histogram)).values()), least + 1)


def exact(pieces, capacity):
    """The fewest sequences by all partitions of the pieces into sets that fit."""
    pieces = sorted(pieces, reverse=True)
    masks = [m for m in range(1, 1 << len(pieces)) if sum(x for i, x in enumerate(pieces) if m >> i & 1) <= capacity]
    fewest = {0: 0}
    for m in range(1, 1 << len(pieces)):
        low = m & -m
        fewest[m] = 1 + min(fewest[m ^ s] for s in masks if s & low and s & ~m == 0)
    return fewest[(1 << len(pieces)) - 1]


def test_few_pieces_take_the_fewest_sequences(monkeypatch):
    rng = random.Random(5)
    missed = 0
    for _ in range(60):
        pieces = [rng.choice([rng.randrange(1, 60), rng.randrange(20, 45), 33]) for _ in range(rng.randrange(1, 10))]
        want = exact(pieces, 100)
        assert sum(packing.plan_sequences(dict(Counter(pieces)), 100, rounds=60).values()) == want
        with monkeypatch.context() as m:
            m.setattr(packing, "SEARCHED", 0)
            missed += sum(packing.plan_sequences(dict(Counter(pieces)), 100, rounds=60).values()) - want
    assert missed <= 2


def test_fullest_is_best():
    rng = random.Random(6)
    for _ in range(100):
        left = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 100)
        got = packing.fullest(room, sorted(left), left)
        assert not Counter(got) - Counter(left)
        sums = {0}
        for x, n in left.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        assert sum(got) == max(s for s in sums if s <= room)


def test_sequences_come_from_the_program():
    """Where pieces repeat, most sequences are the program's; it covers nearly all pieces and none too often."""
    histogram = {300: 5000, 310: 5000, 320: 5000, 61: 5000, 511: 4000, 513: 4000}
    program = packing.configuration_lp(histogram)
    covered = Counter()
    for pattern, amount in program:
        assert sum(pattern) <= 1024
        for x in pattern:
            covered[x] += amount
    assert all(covered[x] <= n * (1 + 1e-9) for x, n in histogram.items())
    assert sum(covered.values()) > 0.9 * sum(histogram.values())
    counts = {}
    plan = packing.plan_sequences(histogram, counts=counts)
    assert counts["program"] > 0.8 * sum(plan.values())
    assert sum(plan.values()) <= sum(packing.best_fit(histogram).values())
    counts = {}
    packing.plan_sequences({300: 50, 310: 50, 320: 50}, counts=counts)
    assert counts["program"] >= 45 and counts["program"] + counts["rounding"] == 50


def test_knapsack_is_best():
    lengths, values = np.array([3, 5, 7]), np.array([3.0, 5.1, 7.0])
    pattern = packing.price_pattern(values, lengths, 17)
    assert sum(x * k for x, k in pattern.items()) <= 17
    best = max(3.0 * a + 5.1 * b + 7.0 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert abs(sum(values[lengths.tolist().index(x)] * k for x, k in pattern.items()) - best) < 1e-9


def test_encoder_agrees_with_the_tokenizer():
    encode = packing.Encoder(packing.tokenizer_path())
    texts = ["", "a", " a  b ", "It's 12,5\n\n x", "<|endoftext|> in a text", "über 日本 \xa0 x", "word " * 5000, "z" * 30_000, "\u2028 \t\t a"]
    want = [np.array(x.ids, "<u4").tobytes() for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want and encode.ranks is not None


def check_pack(spark, rows, columns="doc_id long, text string"):
    docs = spark.createDataFrame(rows, columns)
    got = [r.asDict() for r in packing.pack(docs, rounds=40).collect()]
    encode = packing.Encoder(packing.tokenizer_path())
    ids = [encode.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows]
    want = Counter()
    for (doc, *_), x in zip(rows, ids, strict=True):
        start, piece = 0, 0
        while start < len(x):
            n = (len(x) - start) % 1024 or 1024
            want[doc, piece, start, n, zlib.crc32(np.array(x[start : start + n], "<u4").tobytes())] += 1
            start, piece = start + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(map(len, ids))
    assert len(by) >= -(-total // 1024)
    return len(by), total


def test_pack_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "no id"), (4, "long words here " * 4000), (5, "x"), (6, "<|endoftext|>")]
    check_pack(spark, rows)
    n, total = check_pack(spark, [(i, "some words " * (i % 90)) for i in range(400)])
    assert n <= total / 1024 * 1.05 + 1


def test_pack_other_columns_and_no_rows(spark):
    check_pack(spark, [(1, "a", 5, 6, 7)], "doc_id long, text string, length long, part int, sequence_id long")
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
