"""What the optimiser makes of the plans: columns and filters reach the scan, Python stays out, nothing gathers all rows."""

import re

import pytest

from postloom.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)", text)


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(registry.queries()["flt_lang"](spark, data))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in text
    assert read_schemas(text) == ["doc_id:bigint,lang:string,source:string"]
    text = plan(registry.queries()["join_left_anti"](spark, data))
    assert all("text" not in s for s in read_schemas(text))


@pytest.mark.parametrize("name", ["flagship_keyword_panel", "kw_regex_flags", "agg_cooccurrence", "fn_tokenise_social", "fn_kskipgram", "agg_poststratify", "agg_vote_majority", "join_spatial", "smp_stratified", "fn_cosine"])
def test_no_python_where_functions_will_do(name, spark, data):
    assert not re.search("Python|Pandas|Arrow", plan(registry.queries()[name](spark, data)))


@pytest.mark.parametrize("name", ["agg_cooccurrence", "kw_sentence_flag", "join_spatial", "agg_nested_quantile_groups", "join_nearest_geocode", "fn_diversity", "agg_kendall_mse"])
def test_no_cross_joins(name, spark, data):
    assert not re.search("CartesianProduct|NestedLoop", plan(registry.queries()[name](spark, data)))


def test_global_ranks_gather_only_counts(spark, data):
    """The one window without partitions runs over a row for each partition, and no cuts are written into the plan."""
    text = plan(registry.queries()["win_row_number_global"](spark, data))
    lines = text.split("\n")
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1 and "functions=[count(1)]" in lines[single[0] + 1]
    assert len(text) == len(plan(registry.queries()["win_row_number_global"](spark, data.replace("0.001", "0.01")))) or len(text) < 6000
