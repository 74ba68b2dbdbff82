"""The pipeline against its stages' rules worked out by brute force, and the queries of the subpackage."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from postloom.llm import langid, queries, quality
from tests.oracle import connect, rows_of, rows_of_sql


def test_stages_and_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        rows = {r.doc_id: r.text for r in out.collect()}
        kept.append((name, rows))
        before = docs
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        if name == "quality":
            model = quality.learn(before, spark.read.parquet(f"{data}/labels.parquet"))
            source = before.collect()
            scores = quality.score_array(model, pa.array([r.text for r in source], pa.string()))
            assert set(rows) == {r.doc_id for r, s in zip(source, scores, strict=True) if s >= 0.3 and r.text}
        elif name == "language":
            model = langid.learn(before)
            source = before.collect()
            found, scores = langid.predict(model, pa.array([r.text for r in source], pa.string()))
            assert set(rows) == {r.doc_id for r, f, s in zip(source, found, np.array(scores), strict=True) if f != "und" and s >= corpus_pipeline.LEAST_CERTAINTY}
        elif name == "duplicates":
            source = {r.doc_id: r.text for r in before.collect()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in ((i, t.lower().split()) for i, t in source.items())}
            left = sorted(source)
            groups = {i: i for i in left}
            for i in left:
                for j in left:
                    if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                        a, b = groups[i], groups[j]
                        for k in left:
                            if groups[k] == max(a, b):
                                groups[k] = min(a, b)
            assert set(rows) == set(groups.values())
        else:
            items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            source = {r.doc_id: r.text for r in before.collect()}
            assert all(not any(x in t for x in items) for t in rows.values())
            gone = set(source) - set(rows)
            assert all(any(" ".join(x.split()[:8]) in " ".join(source[i].split()) for x in items) for i in gone)
    pieces = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in pieces} == set(kept[-1][1])


DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash long, class_id string, _other int"


def test_stages_decide_by_row(spark, tmp_path):
    """Rows without id and rows that share one: each is judged by its own text."""
    rng = np.random.default_rng(0)
    item, copy = (" ".join(f"{w}{x}" for x in rng.integers(0, 10**6, 40)) for w in ("b", "c"))
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(4)]
    rows = [(1, clean[0]), (1, f"{clean[1]} {item}"), (None, f"x {item}"), (None, clean[2]), (5, None), (6, ""), (6, ""), (7, copy), (7, clean[3]), (8, f"{copy} end"), (None, copy), (2, clean[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 3, "x", 4) for i, t in rows], DOCS)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert found.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted([x for x in rows if item not in (x[1] or "")], key=str)
    kept = corpus_pipeline.duplicate_stage(spark, docs, str(tmp_path))
    want = [(1, clean[0]), (1, f"{clean[1]} {item}"), (None, f"x {item}"), (None, clean[2]), (5, None), (6, ""), (7, copy), (2, clean[3])]
    assert kept.columns == list(corpus_pipeline.COLUMNS) and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_stages_of_no_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, data):
    df = queries.queries()[name](spark, data)
    if name in queries.oracle_sql():
        assert rows_of(df) == rows_of_sql(connect(data), queries.oracle_sql()[name])
    else:
        assert df.count() > 0
