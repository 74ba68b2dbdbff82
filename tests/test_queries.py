"""Every query with an oracle gives the same rows; the others give rows."""

import pytest

from postloom.plans import registry
from tests.oracle import connect, rows_of, rows_of_sql

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, data, con):
    df = registry.queries()[name](spark, data)
    if name in SQL:
        assert rows_of(df) == rows_of_sql(con, SQL[name])
    else:
        assert df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_kendall_whole_takes_all_customers(spark, tmp_path):
    """Customers over the subset's bound count as well."""
    prices = [(k, float(v)) for k, pair in ((1, (1, 9)), (150, (2, 8)), (400, (3, 20)), (9000, (4, 1)), (90000, (5, 30))) for v in pair]
    spark.createDataFrame(prices, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    runs = [(1, 9), (2, 8), (3, 20), (1, 4), (5, 30)]
    signs = [((a > c) - (a < c)) * ((b > d) - (b < d)) for i, (a, b) in enumerate(runs) for c, d in runs[:i]]
    got = registry.queries()["agg_kendall_mse"](spark, str(tmp_path)).first()
    assert got.tau == round(2 * sum(signs) / 20, 9) and got.mse == round(sum((a - b) ** 2 for a, b in runs) / 5, 1)


def test_run_compare_whole_has_all_users_and_deviations(spark, tmp_path):
    events = [(7, "view", 1.0), (7, "view", 3.0), (7, "click", 5.0), (40, "view", 4.0), (900, "view", 2.0), (900, "click", 1.0), (900, "click", 4.0), (901, "click", 9.0)]
    spark.createDataFrame(events, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r for r in registry.queries()["agg_run_compare"](spark, str(tmp_path)).collect()}
    assert {k: (r.view, r.click, r.view_rank) for k, r in got.items()} == {7: (2.0, 5.0, 2), 40: (4.0, None, 1), 900: (2.0, 2.5, 2)}
    assert (got[7].view_std, got[7].click_std, got[900].click_std) == (round(2**0.5, 6), None, round(4.5**0.5, 6))


def test_sentence_flag_whole_needs_the_whole_sentence(spark, tmp_path):
    sentence = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(1, f"so {sentence} on"), (2, sentence[:60] + " other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["kw_sentence_flag"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.has_sentence for r in got} == {1: 1, 2: 0}


def test_nearest_geocode_at_the_poles_is_that_of_sql(spark, tmp_path):
    """Places on a pole are equally far but for the last bits of the distance, which SQL puts in order."""
    rows = [(i, [(0.5 if i % 10 == 0 else 0.3 + i * 7919 % 600 / 9973) * (-1) ** (i % 20 // 10), (i * 104729 % 6007) / 6007 - 0.5]) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows_of(registry.queries()["join_nearest_geocode"](spark, str(tmp_path))) == rows_of_sql(con, SQL["join_nearest_geocode"])
