import re

from postloom.llm import queries


def test_chat_is_native(spark, data):
    text = queries.op8_chat_formatting(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", text)


def test_search_and_scores_have_no_cross_join(spark, data):
    for f in (queries.op7_exact_top_k, queries.op10_benchmark_decontamination, queries.op2_html_extraction):
        text = f(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Cartesian|NestedLoop", text)
        assert "localCheckpoint" not in text
