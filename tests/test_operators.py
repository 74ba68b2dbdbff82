import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.operators import entities, evaluation, geo, lift, match, panels, retrieval, vectors
from postloom.plans import streams
from postloom.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_keeps_ties_or_one(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 2, "c"), ("v", 1, "d")], "user string, at int, post string")
    assert rows(entities.latest(df, "user", "at")) == [("u", 2, "b"), ("u", 2, "c"), ("v", 1, "d")]
    assert rows(entities.latest(df, "user", "at", keep="one")) == [("u", 2, "c"), ("v", 1, "d")]


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("u", "b"), ("u", "a"), ("v", "c"), ("v", "c"), ("v", "a")], "user string, place string")
    assert rows(entities.mode(df, "user", "place")) == [("u", "a", 1), ("v", "c", 2)]


def test_ranked_is_exact_with_ties_and_nulls(spark):
    values = [(i, None if i % 11 == 0 else float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(values, "id int, s double")
    want = sorted(values, key=lambda v: (v[1] is None, -(v[1] or 0), v[0]))
    assert [r.id for r in retrieval.ranked(df, "s", "id", 8).orderBy("rank").collect()] == [v[0] for v in want]
    assert retrieval.ranked(df.limit(0), "s", "id").count() == 0


def test_ordered_counts_and_average_ranks(spark):
    values = [i * 7 % 40 if i % 3 else 5 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    got = {r.v: (r.c, r.before) for r in evaluation.ordered_counts(df.repartition(5), "v").collect()}
    assert got == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}
    ranks = {r.v: r.v_rank for r in evaluation.average_ranks(df, "v").collect()}
    assert ranks[5] == sum(x < 5 for x in values) + (values.count(5) + 1) / 2


def test_ranked_numbers_equal_rows_and_texts_that_begin_alike(spark):
    text = "https://example.com/a/long/beginning/"
    values = [(f"{text}{i % 50:03}", 1.0 if i % 4 else None) for i in range(400)]
    got = retrieval.ranked(spark.createDataFrame(values, "id string, s double"), "s", "id", 16).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 401))
    assert [(r.id, r.s) for r in got] == sorted(values, key=lambda v: (v[1] is None, v[0]))


def test_ranked_cuts_a_shared_score(spark):
    values = [(i * 37 % 1001, 1.0 if i % 3 else float(i % 5)) for i in range(1001)]
    df = spark.createDataFrame(values, "id int, s double")
    want = [v[0] for v in sorted(values, key=lambda v: (-v[1], v[0]))]
    assert [r.id for r in retrieval.ranked(df, "s", "id", 16).orderBy("rank").collect()] == want


@pytest.mark.parametrize("values", [9, 4, 1000])
def test_kendall_over_digits(spark, values, monkeypatch):
    rng = np.random.default_rng(values)
    a, b = rng.integers(0, values, 300), rng.integers(0, values, 300)
    a[:120], b[60:170] = 3, 2  # values of many rows
    want = int((np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum()) / (300 * 299)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 1)], "a int, b int")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for digit, n, merged in ((256, "4", "true"), (4, "7", "false"), (2, "40", "false"), (16, "3", "false")):
            monkeypatch.setattr(evaluation, "DIGIT", digit)
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
            got = evaluation.kendall(df, "a", "b").first()
            assert abs(got.tau - want) < 1e-9 and abs(got.mse - ((a - b) ** 2).mean()) < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert evaluation.kendall(df.limit(0), "a", "b").first().tau is None
    x = rng.integers(0, 50, 77)
    assert evaluation.inversions(x) == sum(x[i] > x[j] for j in range(77) for i in range(j))


def test_votes(spark):
    votes = [("one", "k", "w1", 1), ("agree", "k", "w1", 1), ("agree", "k", "w2", 1), ("agree", "k", "w3", 0), ("tie", "k", "w1", 1), ("tie", "k", "w2", 1), ("tie", "k", "w3", 0), ("tie", "k", "w4", 0), ("twice", "k", "w1", 1), ("twice", "k", "w1", 1)]
    df = spark.createDataFrame(votes, "item string, kind string, worker string, score int")
    assert rows(evaluation.majority(df, "item", "kind", "worker", "score")) == [("agree", "k", 1)]


def test_precision_needs_two_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "rank int, label int")
    got = df.agg(evaluation.precision(F.col("label"), F.col("rank") < 3).alias("a"), evaluation.precision(F.col("label"), F.col("rank") < 4).alias("b")).first()
    assert got.a is None and got.b == 0.5


def test_points_on_edges_and_outside(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    areas = spark.createDataFrame([(1, ring)], "area_id int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 0.0, 0.0), (4, 3.0, 1.0), (5, -0.1, 1.0)], "p int, x double, y double")
    assert sorted(r.p for r in geo.spatial_join(points, areas, 0.7).collect()) == [1, 2, 3]


def test_holes_and_parts(spark):
    texts = [(1, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"), (2, "MULTIPOLYGON Z (((9 9 1, 10 9 1, 10 10 1, 9 9 1)), ((0 0 1, 1 0 1, 1 1 1, 0 0 1)))"), (3, None), (4, "POLYGON EMPTY")]
    areas = spark.createDataFrame(texts, "area_id int, wkt string").select("area_id", geo.rings_of(F.col("wkt")).alias("rings"))
    points = spark.createDataFrame([(1, 0.5, 0.4), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 9.6, 9.5), (5, 5.0, 5.0)], "p int, x double, y double")
    assert sorted((r.p, r.area_id) for r in geo.spatial_join(points, areas, 0.7).collect()) == [(1, 1), (1, 2), (3, 1), (4, 2)]


def _star(n, x, y, size, seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.4, 1, n)
    return np.column_stack([x + r * np.cos(t), y + r * np.sin(t)])


def _odd(ring, p):
    a, b = ring, np.roll(ring, -1, 0)
    inside = np.zeros(len(p), bool)
    for (ax, ay), (bx, by) in zip(a, b, strict=True):
        if ay != by:
            inside ^= ((ay > p[:, 1]) != (by > p[:, 1])) & (p[:, 0] < (bx - ax) * (p[:, 1] - ay) / (by - ay) + ax)
    return inside


@pytest.mark.parametrize("cell", [0.01, 0.5, 100.0])
def test_cells_of_areas_equal_whole_outlines(spark, cell):
    """Stars, holes and parts of many sizes; cells follow the outline, not the area."""
    shapes = {1: [_star(300, 0, 0, 50, 1)], 2: [_star(40, 3, 3, 2, 2), _star(20, 3, 3, 0.5, 3)], 3: [_star(9, -60, 10, 0.02, 4), _star(7, 61, -8, 5, 5)], 4: [np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]])]}
    areas = spark.createDataFrame([(k, [[(float(a), float(b)) for a, b in ring] for ring in rings], "x") for k, rings in shapes.items()] + [(5, None, "x"), (6, [], "x")], "area_id int, rings array<array<struct<x: double, y: double>>>, name string")
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.uniform(-70, 70, (1500, 2)), rng.uniform(0, 6, (800, 2)), rng.normal([-60, 10], 0.02, (300, 2)), [[2, 0], [4, 4], [0, 2]]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(9000, None, 1.0)], "p int, x double, y double")
    got = {(r.p, r.area_id) for r in geo.spatial_join(points, areas, cell).collect()}
    want = set()
    for k, rings in shapes.items():
        odd = np.logical_xor.reduce([_odd(r, p) for r in rings])
        want |= {(int(i), k) for i in np.flatnonzero(odd)}
    want |= {(len(p) - j, 4) for j in (1, 2, 3)}  # on the edge
    assert got == want


def test_large_areas_have_few_cells():
    box = [{"x": float(a), "y": float(b)} for a, b in ((0.3, 0.3), (5000, 0.3), (5000, 5000), (0.3, 5000))]
    assert len(geo.cover([box], 0.1)) < 50
    ring = [{"x": float(a), "y": float(b)} for a, b in _star(5000, 0, 0, 100, 7)]
    cells = geo.cover([ring], 1.0)
    assert len(cells) < 40_000 and sum(len(c[6]) for c in cells) / sum(1 for c in cells if c[6]) < 13


def test_contains_any(spark):
    docs = spark.createDataFrame([(1, "xa b c dy"), (2, "none"), (3, "the end"), (4, None)], "doc_id int, text string")
    sentences = spark.createDataFrame([("a b c d",), ("the en",), ("",), (None,)], "sentence string")
    assert rows(match.contains_any(docs, sentences)) == [(1, True), (2, False), (3, True), (4, False)]


def test_quantile_groups_and_buckets(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    got = panels.quantile_groups(df, ["g"], "v", [0.0, 0.5, 1.0])
    assert sorted({r.q for r in got.collect()}) == [0, 1, 2]


def test_diversity_over_blocks(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(1, 5)), 30, 0), rng.normal(size=5) + rng.normal(scale=0.05, size=(50, 5))])
    n = len(v)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(990, [0.0] * 5), (991, None), (992, [1.0, 2.0, 3.0, None, 4.0])], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    off, far = s[np.triu_indices(n, 1)], 1 - np.where(np.eye(n, dtype=bool), 2, s).min(1)
    got = vectors.diversity(df, "id", "v", block=16).first()
    want = {"mean_diversity": -off.mean(), "mean_diversity_std_error": off.std(ddof=1) / len(off) ** 0.5, "mean_max_diversity": far.mean(), "mean_max_diversity_std_error": far.std(ddof=1) / n**0.5}
    for k, x in want.items():
        assert abs(got[k] - x) < 1e-9, k
    assert list(vectors.diversity(df.filter("id = 1"), "id", "v").first()) == [None] * 4
    assert abs(vectors.diversity(df.filter("id BETWEEN 60 AND 70"), "id", "v").first().mean_max_diversity) < 1e-9


def _clouds(n=4, size=80, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dim))
    return np.concatenate([c + rng.normal(scale=0.15, size=(size, dim)) for c in centres])


def test_bounds_exclude_most_pairs_of_blocks_and_lose_none(spark, monkeypatch):
    v = _clouds(8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    met, whole = [], vectors.block_pairs

    def counted(blocks, bounds, keep):
        pairs = whole(blocks, bounds, keep)
        met.append((pairs.select("i", "j").count(), len(bounds.ids)))
        return pairs

    monkeypatch.setattr(vectors, "block_pairs", counted)
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 0.8, block=16).collect()}
    s = u @ u.T
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.8}
    (pairs, blocks), = met
    assert blocks > 20 and pairs < 0.35 * blocks * (blocks + 1) / 2
    met.clear()
    far = vectors.diversity(df, "id", "v", block=16).first().mean_max_diversity
    assert abs(far - (1 - s.min(1)).mean()) < 1e-9
    assert sum(p for p, _ in met) < 0.9 * blocks * (blocks + 1) / 2


def test_similar_classes_count_copies(spark):
    v = np.concatenate([_clouds(3, 20), np.repeat(_clouds(1, 1, seed=5), 500, 0)])
    v[10] = v[-1] + 0.01
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {r.id: (r["class"], r.n_links) for r in vectors.similar_classes(df, "id", "v", 0.8).collect()}
    links = (u @ u.T >= 0.8).sum(1) - 1
    assert got == {i: (min(i, 60), links[i]) for i in range(len(v))}


def test_ngram_counts(spark, monkeypatch):
    """Counts, sums and groups with nulls, over one text at a time, are those of all n-grams listed."""
    texts = ["A b  a b", "a b a B a b", None, "", "a", " ", "c É c É c", "b a\nb a"]
    data = [(("x", "y", None)[i % 3], t, None if i % 4 == 1 else i - 3) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(data, "g string, text string, v long").coalesce(1)
    for chunk in (1, lift.CHUNK):
        monkeypatch.setattr(lift, "CHUNK", chunk)
        for n in (1, 2, 3):
            want = {}
            for g, t, v in data:
                w = t.lower().split(" ") if t is not None else []
                for i in range(len(w) - n + 1):
                    want.setdefault((g, " ".join(w[i : i + n])), []).append(v)
            known = {k: [v for v in vs if v is not None] for k, vs in want.items()}
            got = lift.ngram_counts(df, n, by=F.col("g"), number=F.col("v")).collect()
            assert {(r.by, r.gram): (r.n, r.total, r.known) for r in got} == {k: (len(vs), sum(known[k]), len(known[k])) for k, vs in want.items()} and len(got) == len(want)


def test_communities_are_greedy(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(6, 4)), [9, 7, 5, 3, 2, 1], axis=0) + rng.normal(scale=0.25, size=(27, 4))
    v[20:23] = v[3]  # copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sets = {i: {j for j in range(27) if u[i] @ u[j] >= 0.9} | {i} for i in range(27)}
    want = set()
    while True:
        best = max((k for k in sets if len(sets[k]) >= 3), key=lambda k: (len(sets[k]), -k), default=None)
        if best is None:
            break
        gone = sets[best]
        want |= {(best, j) for j in gone}
        sets = {k: s - gone for k, s in sets.items() if k not in gone}
    assert set(rows(vectors.communities(df, "id", "v", 0.9, 3))) == want


def test_communities_of_many_rounds(spark):
    """A chain in which each community waits for the one before: as many rounds as communities."""
    n = 53  # hub k has n + 2 - k leaves of its own, and one leaf shared with hub k + 1
    edges = [(1000 * k, 1000 * k + j) for k in range(n) for j in range(1, n + 3 - k)] + [(1000 * (k + 1), 1000 * k + 1) for k in range(n - 1)]
    ids = sorted({x for e in edges for x in e})
    pairs = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long").coalesce(1).cache()
    got = rows(vectors.greedy(pairs, spark.createDataFrame([(i, 1) for i in ids], "class long, n long"), 3))
    near = {i: {i} for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = set()
    while any(len(x) >= 3 for x in near.values()):
        best = max(near, key=lambda i: (len(near[i]), -i))
        gone = near[best]
        want |= {(best, j) for j in gone}
        near = {i: x - gone for i, x in near.items() if i not in gone}
    assert set(got) == want and len({c for c, _ in got}) == n


def test_communities_of_many_batches(spark):
    """Few candidates and links at a time, in small blocks: the same greedy result, copies and vectors of other lengths too."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(200, 3))
    v[150:160] = v[3]  # copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900 + i, [1.0]) for i in range(4)] + [(990, [2.0, 1.0])], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sets = {i: {j for j in range(200) if u[i] @ u[j] >= 0.8} | {i} for i in range(200)}
    want = {(900, 900 + i) for i in range(4)}
    while max(map(len, sets.values()), default=0) >= 3:
        best = max(sets, key=lambda k: (len(sets[k]), -k))
        gone = sets[best]
        want |= {(best, j) for j in gone}
        sets = {k: x - gone for k, x in sets.items() if k not in gone}
    for candidates, links in ((9, 1000), (1000, 25)):
        got = rows(vectors.communities(df, "id", "v", 0.8, 3, block=32, candidates=candidates, links=links))
        assert len(got) == len(want) and set(got) == want


def test_communities_of_many_links(spark):
    """Links are counted in the tiles: what is shuffled doesn't grow with them."""
    v = np.random.default_rng(5).normal(size=(3000, 3))  # two million links
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    written = lambda: sum(e.totalShuffleWrite() for e in (store.apply(i) for i in range(store.size())))
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    before = written()
    got = rows(vectors.communities(df, "id", "v", 0.1, 10))
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    assert len({m for _, m in got}) == len(got) > 2900
    assert written() - before < 40e6


def test_streams_of_many_spans(spark, data, monkeypatch):
    """Files, and so micro-batches, hold bounded spans of time in order; the results are those of one batch."""
    one = sorted(rows(streams.stream_sessions(spark, data)))
    monkeypatch.setattr(streams, "ROWS", 300, raising=False)
    _, path = streams._stream(spark, data)
    files = spark.read.parquet(f"{path}/*").withColumn("f", F.col("_metadata.file_path")).groupBy("f", "_metadata.file_modification_time").agg(F.count("*"), F.min("ts"), F.max("ts")).orderBy("file_modification_time").collect()
    assert len(files) == 8 and sum(f[2] for f in files) == 2001 and max(f[2] for f in files) <= 600
    assert len({f[1] for f in files}) == 8 and all(f[4] < g[3] for f, g in zip(files, files[1:], strict=False))
    assert sorted(rows(streams.stream_sessions(spark, data))) == one
    ids = rows(streams.stream_dedupe(spark, data))
    assert len(ids) == len(set(ids)) == 1000
    assert sum(n for _, n in rows(streams.stream_windowed_counts(spark, data))) == 2000


def test_motifs_beyond_the_first_slice(spark):
    data = [(f"the w{i}", float(100 - i)) for i in range(20)] + [("a b", 5.0), ("b c", 5.0), ("c d", 4.0), ("x x", 3.0), ("y z", None), ("z q", None), ("k l", None)]
    df = spark.createDataFrame(data, "motif string, lift double")
    assert retrieval.greedy_motifs(df, 5, 3) == ["the w0", "a b", "c d", "k l", "y z"]


def test_corrupt_and_marked_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([('{"id": 1, "place":{"x": 1}}',), ('{"id": 2}',), ('{"place":{broken',)], "value string").write.text(path)
    got = readers.corrupt_rows(spark, path, "id INT, place STRUCT<x: INT>").agg(F.sum("n"), F.sum("n_corrupt")).first()
    assert tuple(got) == (3, 1)
    assert [r.id for r in readers.marked_json(spark, path, "id INT, place STRUCT<x: INT>", ['"place":{']).filter("id IS NOT NULL").collect()] == [1]


def test_listing_difference(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "path string, length int")
    b = spark.createDataFrame([("p", 1), ("q", 5), ("s", 3)], "path string, length int")
    assert rows(writers.listing_difference(a, b)) == [("q", "size"), ("r", "missing"), ("s", "extra")]


def test_platt_separates_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    df = spark.createDataFrame([("a", float(i), float(j)) for i, j in zip(x, y, strict=True)] + [("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in evaluation.platt(df, "x", "y", "g").collect()}
    assert set(got) == {"a"} and abs(got["a"].slope - 2) < 0.6 and abs(got["a"].intercept + 1) < 0.5


def test_nearest_finds_a_place_for_every_point(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(size=(80, 2)), [[500.0, -3.0], [40.0, 9000.0], [0.31, 0.0]]])
    at = np.concatenate([rng.normal(size=(25, 2)), [[0.62, 0.0], [0.0, 0.0]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, 1.0)], "point_id int, x double, y double")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "place_id int, px double, py double")
    want = [((xy[i] - at) ** 2).sum(1) for i in range(len(xy))]
    for cell in (0.1, 3.0):
        got = geo.nearest(points, places, cell).collect()
        assert sorted((r.point_id, r.place_id) for r in got) == [(i, int(d.argmin())) for i, d in enumerate(want)]
        assert all(abs(r.distance - want[r.point_id].min() ** 0.5) < 1e-9 for r in got)
    assert geo.nearest(points, places.limit(0), 1.0).count() == 0 and geo.nearest(points.limit(0), places, 1.0).count() == 0


def test_samples_of_large_ids(spark):
    df = spark.range(2000).select((F.col("id") * 4194304 + 1_260_000_000_000_000_000).alias("id"))
    some = retrieval.fraction_sample(df, "id", 0.2)
    assert 300 < some.count() < 500 and set(rows(some)) == set(rows(retrieval.fraction_sample(df.repartition(3), "id", 0.2)))
    assert retrieval.per_group(df.withColumn("g", F.col("id") % 3), "g", 5, [retrieval.hash_order(F.col("id"))]).count() == 15


def test_rank_lists(spark):
    points = sorted({int(10 ** (i + k / max(i, 1))) if i else 1 for i in range(3) for k in range(i + 1)})
    assert points == [1, 10, 100, 316, 1000]
    assert retrieval.log_ranks(3, 3) == sorted({1, 2, 3} | {p + k for p in points[1:] for k in (1, 2, 3)})
    assert {4642, 4651, 17783, 31623, 251189} <= set(retrieval.log_ranks()) and 4652 not in retrieval.log_ranks()
    assert retrieval.spaced_ranks()[:20] == list(range(1, 21)) and {22, 41, 307, 326, 999_991, 1_000_010} <= set(retrieval.spaced_ranks())
    ranks = spark.range(1, 5000).withColumnRenamed("id", "rank")
    assert [r[0] for r in rows(ranks.filter(retrieval.on_steps(F.col("rank"), 2, 300)))] == [*range(1, 11), *range(91, 101), *range(191, 201), *range(291, 301)]
    assert [r[0] for r in rows(ranks.filter(retrieval.on_steps(F.col("rank"), 3, 2000)))] == [*range(1, 11), *range(91, 101), *range(991, 1001), *range(1991, 2001)]


def test_ranked_cuts_shared_and_missing_scores_by_text(spark):
    values = [(f"{i * 7919 % 1000:04}", None if i % 2 else 1.0) for i in range(1000)] + [(None, 1.0)]
    df = spark.createDataFrame(values, "id string, s double")
    got = [r.id for r in retrieval.ranked(df, "s", "id", 8).orderBy("rank").collect()]
    assert got == [None] + sorted(i for i, s in values if s and i) + sorted(i for i, s in values if s is None)


def test_short_sentences_of_any_letters_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "say (a+b) now"), (1, "nothing"), (2, "über.alles"), (2, None), (None, "x|y"), (3, "ab")], "doc_id int, text string")
    sentences = spark.createDataFrame([("(a+b)",), ("über.",), ("x|y",), ("a+b) n",)], "sentence string")
    want = [(None, "True"), (1, "False"), (1, "True"), (2, "False"), (2, "True"), (3, "False")]
    for most in (1 << 20, 4):
        got = match.contains_any(docs, sentences, part_bytes=most).collect()
        assert sorted(((r.doc_id, str(r.found)) for r in got), key=str) == sorted(want, key=str)
    assert match.contains_any(docs, sentences.limit(0)).filter("found").count() == 0


def test_bootstrap_draws_as_many_of_both(spark):
    df = spark.createDataFrame([(i, int(i < 7), float(i)) for i in range(60)], "id int, y int, v double")
    got = evaluation.bootstrap_draws(df, "id", "y", 40).collect()
    for r in range(1, 41):
        drawn = [x.id for x in got if x.round == r]
        assert sum(i < 7 for i in drawn) == 7 and sum(i >= 7 for i in drawn) == 7
    assert len({tuple(sorted(x.id for x in got if x.round == r)) for r in range(1, 41)}) > 35
    assert len({x.id for x in got}) > 50
    fewer = evaluation.bootstrap_draws(df.withColumn("y", 1 - F.col("y")), "id", "y", 3).collect()
    assert all(sum(x.round == r and x.y == 0 for x in fewer) == 7 and sum(x.round == r and x.y == 1 for x in fewer) == 53 for r in (1, 2, 3))


def test_attention_classes(spark):
    good = ["1", "1", "2", "2", "2", "2", "2", "2", "1", "2"]
    workers = {"all": good, "both": ["2", *good[1:]], "first": [*good[:8], "2", "2"], "none": ["1"] * 10, "short": good[:5], "late": [None, *good[1:]]}
    df = spark.createDataFrame([(w, k, a) for w, answers in workers.items() for k, a in enumerate(answers)], "w string, k int, a string")
    got = {r.w: r["class"] for r in evaluation.attention(df, "w", "k", "a", good, ((1, 4), (8, 9))).collect()}
    assert got == {"all": 3, "both": 2, "first": 1, "none": 0, "short": 1, "late": 2}
    assert {r.w for r in evaluation.attention(df, "w", "k", "a", good, ((1, 4), (8, 9)), least=2).collect()} == {"all", "both", "late"}


def test_many_phrases_take_one_scan_a_part(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefg é😀"), 9)) for _ in range(100_000)]
    texts = ["".join(rng.choice(list("abcdefg é😀"), 400)) for _ in range(60)] + [words[0], "x" + words[5] + "y", "zzz", "", None]
    phrases = spark.createDataFrame([(w,) for w in [*words, "", None]], "p string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    known = set(words)
    want = [None if t is None else any(t[k : k + 9] in known for k in range(len(t))) for t in texts]
    for part_bytes in (1 << 24, 1 << 19):
        got = match.phrase_flags(docs, "t", phrases, "p", part_bytes=part_bytes)
        assert [r.found for r in got.orderBy("id").collect()] == want
    assert True in want and False in want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert [r.found for r in match.phrase_flags(docs, "t", phrases.limit(0), "p").orderBy("id").collect()] == [None if t is None else False for t in texts]


def _great_circle(a, b):
    u, v = (np.radians(np.asarray(x, float)) for x in (a, b))
    h = np.sin((v[None, :, 0] - u[:, None, 0]) / 2) ** 2 + np.cos(u[:, None, 0]) * np.cos(v[None, :, 0]) * np.sin((v[None, :, 1] - u[:, None, 1]) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize("block", [8, 1024])
def test_nearest_on_sphere_equals_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    places = np.concatenate([np.column_stack([rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)]), np.column_stack([rng.uniform(-5, 5, 60), (rng.uniform(178, 182, 60) + 180) % 360 - 180]), [[90, 0], [-90, 77], [10, 180], [10, -180]], [[48.85, 2.35]] * 3, rng.normal([40, -74], 0.02, (200, 2))])
    points = np.concatenate([np.column_stack([rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)]), np.column_stack([rng.uniform(-5, 5, 60), (rng.uniform(178, 182, 60) + 180) % 360 - 180]), [[89.99, 120], [-89.9, -60], [90, 5]], rng.normal([40, -74], 0.5, (100, 2))])
    one = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(points)] + [(9000, None, 1.0), (9001, 95.0, 1.0), (9002, 1.0, float("nan"))], "point_id int, lat double, lon double")
    two = spark.createDataFrame([(i, *map(float, v), "x") for i, v in enumerate(places)] + [(-1, None, 0.0, "x")], "place_id long, lat double, lon double, distance string")
    gaps = _great_circle(points, places)
    got = {r.point_id: (r.place_id, r.distance) for r in geo.nearest_on_sphere(one, two, block).collect()}
    assert set(got) == set(range(len(points)))
    for i, (place, km) in got.items():
        assert abs(km - gaps[i].min()) < 1e-6 and abs(gaps[i, place] - gaps[i].min()) < 1e-6
    assert got[len(points) - 101][0] == 214 - 4  # the pole
    assert geo.nearest_on_sphere(one, two.limit(0)).count() == 0 and geo.nearest_on_sphere(one.limit(0), two).count() == 0


def test_nearest_in_a_city_meets_few_blocks(spark, monkeypatch):
    """100,000 places in one city: a point meets a few blocks of them, and many points of one block are dealt to several tasks."""
    rng = np.random.default_rng(1)
    city, points = rng.normal([40, -74], 0.05, (100_000, 2)), rng.normal([40, -74], 0.06, (300, 2))
    monkeypatch.setattr(geo, "POINTS", 5)
    met, whole = [], geo._candidates
    two = spark.createDataFrame([(i, *v) for i, v in enumerate(city.tolist())], "place_id long, lat double, lon double")
    one = spark.createDataFrame([(i, *v) for i, v in enumerate(points.tolist())], "point_id long, lat double, lon double")
    got = {r.point_id: r.distance for r in geo.nearest_on_sphere(one, two, 512).collect()}
    want = np.concatenate([_great_circle(points[k : k + 20], city).min(1) for k in range(0, 300, 20)])
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-6
    unit = geo._unit(city[:, 0], city[:, 1])
    unit = unit[np.argsort(geo._morton(unit), kind="stable")]
    balls = [unit[k : k + 512] for k in range(0, len(unit), 512)]
    centre = np.array([(b.max(0) + b.min(0)) / 2 for b in balls])
    radius = np.array([np.linalg.norm(b - c, axis=1).max() for b, c in zip(balls, centre, strict=True)])
    i, _ = whole(geo._unit(points[:, 0], points[:, 1]), centre, radius)
    met.append(len(i) / len(points))
    assert met[0] < 0.2 * len(balls)


def test_quantile_arrays_are_exact(spark):
    """Approximate ones are a value off from some ten thousand rows on; nulls don't count, and groups without values have none."""
    values = [("a", float(i * 7919 % 30011)) for i in range(30011)] + [("b", 2.0)] * 3 + [("b", None), ("c", None), (None, 5.0), ("d", float("nan")), ("d", 1.0)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r.quantiles for r in panels.quantile_arrays(df, ["g"], "v", [0.0, 0.1, 0.50001, 0.9, 1.0]).collect()}
    assert got["a"] == [0.0, 3001.0, 15005.0, 27009.0, 30010.0]
    assert got["b"] == [2.0] * 5 and got["c"] is None and got[None] == [5.0] * 5
    assert got["d"][0] == 1.0 and got["d"][-1] != got["d"][-1]


def test_blocks_are_shipped_by_tiles(spark, monkeypatch):
    """Of vectors without clusters every block meets every other; it is shipped for each group of blocks, not for each block."""
    v = np.random.default_rng(4).normal(size=(600, 24))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(vectors, "GROUPS", 3)
    blocks, bounds = vectors.blocks_of(vectors.vector_classes(df, "id", "v"), 16)
    keep = lambda k, low, high: bounds.ids >= bounds.ids[k]
    count = lambda pairs: iter([pd.DataFrame({"n": [1], "m": [sum(1 for _ in pairs)]})])
    tiles, pairs = vectors.block_products(blocks, bounds, keep, count, "n long, m long").groupBy().sum("n", "m").first()
    assert len(bounds.ids) > 30 and tiles == 6 and pairs == len(bounds.ids) * (len(bounds.ids) + 1) // 2
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 0.5, block=16).collect()}
    s = u @ u.T
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.5}


def test_nearest_on_the_plane_meets_few_places_where_they_are_dense(spark, monkeypatch):
    """All places in one grid cell: a point is compared with the places of a few blocks, and far points and equal spots count."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.normal(0, 0.001, (6000, 2)), [[0.0005, 0.0005]] * 3])
    xy = np.concatenate([rng.normal(0, 0.001, (200, 2)), [[1e9, -1e9], [0.0005, 0.0005]]])
    points = spark.createDataFrame([(i, *v) for i, v in enumerate(xy.tolist())] + [(900, float("nan"), 0.0), (901, float("inf"), 0.0)], "point_id long, x double, y double")
    places = spark.createDataFrame([(i, *v) for i, v in enumerate(at.tolist())] + [(-1, None, 0.0)], "place_id long, px double, py double")
    met, whole = spark.sparkContext.accumulator(0), geo._planar
    monkeypatch.setattr(geo, "_planar", lambda x, y, *near: met.add(len(x) * len(near[0])) or whole(x, y, *near))
    got = {r.point_id: (r.place_id, r.distance) for r in geo.nearest(points, places, 0.05, block=16).collect()}
    squares = (xy[:, None, 0] - at[:, 0]) ** 2 + (xy[:, None, 1] - at[:, 1]) ** 2
    assert {i: p for i, (p, _) in got.items()} == dict(enumerate(squares.argmin(1).tolist())) and got[201] == (6000, 0.0)
    assert met.value < 0.25 * len(xy) * len(at)
