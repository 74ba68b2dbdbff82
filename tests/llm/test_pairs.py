"""Top-k, near-duplicates, components and decontamination against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from postloom.llm import decontaminate, jaccard, topk
from postloom.llm.components import components


def vectors():
    rng = np.random.default_rng(0)
    v = rng.normal(scale=0.2, size=(300, 6)).round(2)
    v[50:90] = v[50]
    rows = [(i, x.tolist(), 0, "a") for i, x in enumerate(v)]
    rows += [(1000, None, 0, "a"), (1001, [0.1, None, 0.1, 0.1, 0.1, 0.1], 0, "a"), (1002, [math.nan] * 6, 0, "a"), (1003, [math.inf] * 6, 0, "a"), (None, [0.1] * 6, 0, "a"), (1004, [], 0, "a")]
    return rows + [(1020, [0.5, 0.5], 0, "a"), (1021, [0.5, 1.5], 0, "a"), (40, [0.1] * 6, 0, "a"), (41, [9.0] * 6, 0, "a")]


def brute_top(rows, k):
    usable = [(i, tuple(math.floor(64 * x) for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in usable if i % 20 == 0}:
        query = min(v for i, v in usable if i == q)
        found = sorted((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(query))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def test_top_k(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string")
    for blocks in (64, 1 << 16):
        got = topk.top_k(df, k=7, index_rows=blocks, query_rows=4, few_queries=2)
        assert {tuple(r) for r in got.collect()} == brute_top(rows, 7)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Components of any finite size take part; scores beyond a long stay in order and are given as the nearest long."""
    rng = random.Random(0)
    size = lambda: rng.choice([1.0, 1e3, 1e8, 2.0**25, 1e17, 1e200, 1.7e308]) * rng.uniform(-1, 1)
    rows = [(i, [size() for _ in range(3)]) for i in range(90)]
    rows += [(200, [1e8]), (201, [1e8]), (202, [2e8]), (203, [-1e8]), (220, [0.0]), (221, [float("inf")])]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9, index_rows=32, few_queries=2).collect()}
    whole = lambda x: int(x) * 64 if abs(x) >= 2.0**53 else math.floor(64 * x)
    usable = [(i, [whole(x) for x in v]) for i, v in rows if all(math.isfinite(x) for x in v)]
    want = set()
    for q, v in usable:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:9]
            want |= {(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(found, 1)}
    assert got == want and {r[2] for r in got if r[0] == 200} == {201, 202, 203, 220}


def naive_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def near_copies():
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows, passage = [], [word() for _ in range(60)]
    for group in range(25):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 60 if group == 0 else 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(60)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, rows[0][1]), (n + 5, rows[0][1]), (n + 6, "x " * 5000), (None, "some text without an id at all"), (n + 7, "y " * 40_000 + rows[1][1])]
    return rows


def test_near_duplicates(spark, monkeypatch):
    rows = near_copies()
    sets = naive_sets([t for _, t in rows])
    n, links, root = len(rows), Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    want = Counter((rows[i][0], least.get(find(i)), links[i]) for i in range(n))
    df = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, ck string, n int")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect())
    assert got == want
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(jaccard, "HOT_NODE", 10)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()) == want
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_depth_reaches_the_recall():
    k = jaccard.prefix_depth()
    assert jaccard.chance(0.8, k) >= jaccard.RECALL > jaccard.chance(0.8, k + 1)


def paths_and_sketches(rng, n=400):
    paths = np.zeros((n, jaccard.PATH), np.uint8)
    paths[:, 0] = rng.integers(0, 3, n)
    paths[:, 2::2] = rng.integers(0, 2, (n, jaccard.DEPTH))  # few values, so that nodes of many classes come up
    paths[:120, 1:12] = 1
    paths = paths[np.lexsort(paths.T[::-1])]
    return np.arange(n) + 1000, paths, rng.integers(0, 2**63, (n, 4)).astype(np.uint64)


def groups_of(pairs, keys):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(k) for k in keys]


@pytest.mark.parametrize("least", [0, 128, 140])
def test_meetings_of_all_depths_connect_what_shares_a_prefix(least):
    keys, paths, sketch = paths_and_sketches(np.random.default_rng(1))
    agree = 256 - np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(2, dtype=np.int64)
    met = set()
    for depth in range(jaccard.DEPTH, 3, -1):
        now = {tuple(sorted(x)) for x in zip(*(y.tolist() for y in jaccard.meetings(keys, paths, sketch, depth, least)), strict=True)}
        met |= now
        want = {(keys[i], keys[j]) for i in range(len(keys)) for j in range(i + 1, len(keys)) if agree[i, j] >= least and (paths[i, : 1 + 2 * depth] == paths[j, : 1 + 2 * depth]).all()}
        assert met <= want
        a, b = groups_of(met, keys.tolist()), groups_of(want, keys.tolist())
        assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_prefixes_are_shortened_only_as_far_as_the_pairs_need(spark, monkeypatch):
    depths = []
    meet = jaccard._meet
    monkeypatch.setattr(jaccard, "_meet", lambda depth, *rest: depths.append(depth) or meet(depth, *rest))
    rng = random.Random(2)
    words = [["".join(rng.choices("abcdef", k=4)) for _ in range(400)] for _ in range(20)]
    alike = [(2 * i + k, " ".join([*w, "x" * k])) for i, w in enumerate(words) for k in range(2)]
    found = jaccard.near_duplicates(spark.createDataFrame(alike, "doc_id long, text string")).collect()
    assert depths == [jaccard.DEPTH] and all(r.class_id == r.doc_id // 2 * 2 and r.n_links == 1 for r in found)
    depths.clear()
    apart = alike + [(1000, " ".join(words[0][:325]))]
    found = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(apart, "doc_id long, text string")).collect()}
    assert depths == list(range(jaccard.DEPTH, jaccard.prefix_depth() - 1, -1)) and found[1000].class_id == 0 and found[0].n_links == 2


@pytest.mark.parametrize("seed", [113, 797])
def test_a_pair_that_whole_paths_miss_is_found_among_many_likelier_ones(spark, seed):
    """The pair shares seven or six values in its best tree; 450 pairs that are more alike don't hide it."""
    words = [f"w{seed}x{i}" for i in range(49)]
    other = [*words[:20], f"z{seed}", *words[21:]]
    alike = [(10 + 2 * i + k, " ".join([*(f"d{i}y{j}" for j in range(120)), *["more"] * k])) for i in range(450) for k in range(2)]
    docs = [(1, " ".join(words)), (2, " ".join(other)), *alike]
    found = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[2].class_id == 1 and found[1].n_links == 1 and all(found[10 + 2 * i].n_links == 1 for i in range(450))


def test_a_shared_passage_links_nothing(spark, monkeypatch):
    """Hundreds of documents that share more than half of their shingles: none is as similar as the threshold."""
    monkeypatch.setattr(jaccard, "HOT_NODE", 100)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdef", k=5))
    passage = [word() for _ in range(150)]
    rows = [(i, " ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(20))])) for i in range(400)]
    rows += [(1000, rows[7][1] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda keys, *rest: asked.append(len(keys)) or verify(keys, *rest))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()}
    assert got == {i: (7, 1) if i in (7, 1000) else (i, 0) for i, _ in rows}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(shape, spark):
    rng = random.Random(3)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], "none": []}[shape]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    code = {x: (x * 2654435761) % 1_000_003 for x in root}
    got = {r.node: r.root for r in components(spark.createDataFrame([(code[a], code[b]) for a, b in pairs], "a long, b long")).collect()}
    alone = {x for x in root if all(a == b for a, b in pairs if x in (a, b))}
    assert set(got) == {code[x] for x in root if x not in alone}
    for x in got and root:
        for y in root:
            if x not in alone and y not in alone:
                assert (got[code[x]] == got[code[y]]) == (find(x) == find(y))


def edits(a, b):
    """Least edit distance between a and any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 50)))) for i in range(30)]
    items += [(100, " ".join(rng.choices(vocabulary, k=10))), (101, " ".join(rng.choices(vocabulary, k=6))), (102, "too short"), (103, None), (104, ""), (105, items[0][1]), (106, "Zyzzyva"), (107, "zyzzyva  what is"), (108, "zyzzyva what is life now then")]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        if i % 2:
            passage = items[rng.randrange(32)][1].split()
            for _ in range(rng.randint(0, len(passage) // 8) if len(passage) > 7 else 0):
                k = rng.randrange(len(passage))
                if rng.random() < 0.4:
                    passage[k] = rng.choice(vocabulary).upper()
                elif rng.random() < 0.5:
                    del passage[k]
                else:
                    passage.insert(k, rng.choice(vocabulary))
            k = rng.randint(0, len(words))
            words[k:k] = passage
        docs.append((i, "\n ".join(words)))
    docs += [(500, None), (501, ""), (502, items[0][1].upper()), (502, items[0][1].upper()), (None, items[1][1]), (503, " ".join(rng.choices(vocabulary, k=60_000)) + " " + items[2][1])]
    docs += [(504, "a b zyzzyva what is gone"), (505, "zyzzyva what WAS life now then"), (506, "zyzzyva what life now"), (507, "zyzzyva\x0bwhat\fis life now then")]
    known = {i: t.lower().split() for i, t in items if t and i != 105}
    want = Counter()
    for i, t in docs:
        if i == 503:
            continue
        w = (t or "").lower().split()
        for k, item in known.items():
            d = edits(item, w)
            if d <= len(item) // 5:
                want[i, k, d] += 1
    want[503, 2, 0] += 1
    df, bench = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(df, bench)
    got = Counter((r.doc_id, r.item_id, r.distance) for r in found.collect())
    assert not {(a, b) for a, b, _ in got} - {(a, b) for a, b, _ in want}
    missed = {(a, b) for a, b, _ in want} - {(a, b) for a, b, _ in got}
    assert len(missed) <= 0.01 * len(want)
    assert all(d == e for a, b, d in got for x, y, e in want if (a, b) == (x, y))
    assert {(a, b) for a, b, d in want if d == 0} <= {(a, b) for a, b, _ in got}
    assert got[502, 0, 0] == 2 and {r.n_items for r in found.collect() if r.item_id == 0} == {2}
    assert {b for a, b, _ in got if a == 505} == {106, 108} and {b for a, b, _ in got if a == 504} == {106, 107}
    several = decontaminate.find(df, bench, part_bytes=2000)
    assert Counter((r.doc_id, r.item_id, r.distance) for r in several.collect()) == got
    assert decontaminate.find(df.limit(0), bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0


def filters_of(part):
    out = []
    for each in decontaminate.cells(part):
        out.append([])
        for found in each:
            usable = np.zeros(1 << decontaminate.FILTER_BITS, bool)
            usable[found] = True
            out[-1].append(usable)
    return out


@pytest.fixture(scope="module")
def chosen():
    rng = np.random.default_rng(3)
    return decontaminate.plan([rng.integers(0, 2**62, n).astype(np.uint64) for n in range(1, 130)])


def share_found(chosen, lengths, kinds, count=80):
    """By length, of items with all edits allowed, each in a document of its own between other words."""
    rng = np.random.default_rng([*lengths, *kinds])
    items = [rng.integers(0, 2**62, n).astype(np.uint64) for n in lengths for _ in range(count)]
    part = decontaminate.build(list(range(len(items))), items, chosen)
    docs, first = [], [0]
    for item in items:
        own = decontaminate.edited(item, len(item) // 5, kinds, rng)
        around = [rng.integers(0, 2**62, k).astype(np.uint64) for k in (int(rng.integers(9)), 20)]
        docs += [around[0], own, around[1]]
        first.append(first[-1] + sum(map(len, docs[-3:])))
    hashes, first = np.concatenate(docs), np.array(first)
    keys = decontaminate.passing(chosen.scans, filters_of(part), hashes, first)
    found = decontaminate.search(part, keys, hashes, first)
    assert all(text == item for text, item in found)
    return {n: sum((i, i) in found for i in range(k * count, (k + 1) * count)) / count for k, n in enumerate(lengths)}


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (0, 1, 2)])
def test_items_of_every_length_with_all_allowed_edits_are_found(chosen, kinds):
    shares = share_found(chosen, [*range(1, 26), 28, 30, 33, 35, 38, 40, 45, 50, 55, 60, 100], kinds)
    assert all(v == 1 for n, v in shares.items() if n < 8)  # pieces are exact
    assert min(shares.values()) >= 0.98 and sum(shares.values()) / len(shares) >= 0.998


def test_pieces_take_the_place_of_walks_that_miss_too_much():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 2**62, n).astype(np.uint64) for n in range(15, 40)]
    few = decontaminate.plan(items, most=1)
    lengths = [n for n in range(15, 40) if decontaminate.group_of(n, 0.2) in few.by_pieces]
    assert lengths and set(share_found(few, lengths, (2,), 100).values()) == {1}
