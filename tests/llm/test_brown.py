import math
import zlib
from collections import Counter

import numpy as np

from postloom.llm import brown

SCHEMA = "doc_id long, text string, word string, n long"


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def rows():
    rng = np.random.default_rng(0)
    a, b = ["the", "a"], ["cat", "dog", "cow", "hen"]
    out = [(i, " ".join(f"{rng.choice(a)} {rng.choice(b)} {rng.choice(['Runs', 'sits', 'eats'])}" for _ in range(rng.integers(1, 20))), "x", 1) for i in range(120)]
    return out + [(500, None, "x", 1), (501, "", "x", 1), (502, " \t\n", "x", 1), (None, "the cat", "x", 1), (503, "Éé unheard-of", "x", 1), (7, "the cat", "x", 1), (7, "the cat", "x", 1), (504, "the " * 30_000, "x", 1)]


def test_counts_and_base_score(spark):
    data = rows()
    got = brown.score(spark.createDataFrame(data, SCHEMA), clustered=5, frequent=6, endings=4, classes=6).collect()
    words = [(i, (t or "").encode().lower().split()) for i, t, *_ in data]
    counts, texts = Counter(), 0
    for i, w in words:
        if i is not None and not held(i):
            counts.update(w)
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    want = Counter()
    for i, w in words:
        base = math.log10((texts + 1) / (n + v + 1)) + sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i, i is not None and held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one(spark):
    """After any class: its transitions sum to one, and so do a class's emissions with one unseen word."""
    training = spark.createDataFrame([(t,) for _, t, *_ in rows()[:100]], "text string")
    counts = spark.createDataFrame(list(Counter(w for _, t, *_ in rows()[:100] for w in t.encode().lower().split()).items()), "word binary, n long")
    m = brown.learn(training, counts, 1, clustered=5, endings=3, classes=6, rounds=3)
    assert np.allclose((10.0**m.step).sum(1), 1)
    seen = np.zeros(6)
    item = m.items.of([bytes(r.word) for r in counts.collect()])[1]
    for r, k in zip(counts.collect(), item, strict=True):
        seen[m.group[k]] += (r.n + 1) / 10.0 ** m.room[m.group[k]]
    for c in range(1, 6):
        unseen = 1 / 10.0 ** m.room[c]
        assert abs(seen[c] + unseen - 1) < 1e-9
    assert m.group[0] == 0 and (m.group[1:] > 0).all()


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    kinds = np.array([0] + [1] * 6 + [2] * 6 + [3] * 6)
    chain = {0: 1, 1: 2, 2: 3, 3: 1}
    pairs = np.zeros((19, 19))
    at = 0
    for _ in range(4000):
        following = rng.choice(np.flatnonzero(kinds == chain[kinds[at]]))
        pairs[at, following] += 1
        at = following
    group = brown.exchange(pairs, 4, 20)
    assert len({(k, g) for k, g in zip(kinds, group, strict=True)}) == 4


def test_nothing_to_learn(spark):
    assert brown.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if held(i))
    r = brown.score(spark.createDataFrame([(only, "a b", "x", 1)], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_further_words_get_the_class_of_their_neighbours(spark):
    """Words beyond the clustered ones, also those that aren't broadcast, all of one ending, are told apart."""
    rng = np.random.default_rng(4)
    left, right = [f"l{x}end" for x in range(8)], [f"r{x}end" for x in range(8)]
    share = np.array([0.3, 0.3, *[0.4 / 6] * 6])  # the first two are clustered
    texts = [" ".join(w for _ in range(10) for w in ("aa", rng.choice(left, p=share), "bb", rng.choice(right, p=share))) for _ in range(60)]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    found = Counter(w for t in texts for w in t.encode().split())
    counts = spark.createDataFrame(list(found.items()), "word binary, n long")
    least = sorted(found.values())[-8]
    _, _, assigned = brown.cluster(training, counts, least, clustered=6, endings=1, classes=6)
    place = {bytes(r.word): (r["class"], r.n) for r in assigned.collect()}
    assert {w: n for w, (_, n) in place.items()} == {w: n for w, n in found.items() if w[:2] not in (b"aa", b"bb", b"l0", b"l1", b"r0", b"r1")}
    one, two = ({place[w.encode()][0] for w in side[2:]} for side in (left, right))
    assert len(one) == len(two) == 1 and one != two


def test_score_by_brute_force(spark, monkeypatch):
    """Every token's transition and emission, word by word, from the classes and counts that were learned."""
    kept = {}
    finish = brown.finish

    def watch(items, group, assigned, training, counts, paths, classes):
        kept["model"] = finish(items, group, assigned, training, counts, paths, classes)
        kept["assigned"] = {bytes(r.word): (r["class"], r.n) for r in assigned.collect()}
        return kept["model"]

    monkeypatch.setattr(brown, "finish", watch)
    data = rows()
    got = brown.score(spark.createDataFrame(data, SCHEMA), clustered=5, frequent=6, endings=4, classes=6).collect()
    m, assigned = kept["model"], kept["assigned"]
    first = {w: (int(m.group[1 + i]), int(n)) for i, (w, n) in enumerate(zip(m.items.words[: m.items.clustered], m.items.counts, strict=False))}
    tail = {e: int(m.group[1 + m.items.clustered + k]) for k, e in enumerate(m.items.endings)}
    want = Counter()
    for i, t, *_ in data:
        total, last = 0.0, 0
        for w in (t or "").encode().lower().split():
            kind, n = first.get(w) or assigned.get(w) or (tail.get(w[-brown.ENDING :], int(m.group[m.items.rest])), 0)
            total += m.step[last, kind] + math.log10(n + 1) - m.room[kind]
            last = kind
        want[i, round(total + m.step[last, 0], 3)] += 1
    assert Counter((r.doc_id, round(r.score, 3)) for r in got) == want
