"""Plan-shape checks that keep the scale properties in place."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_join(spark):
    for name, fn in E.queries().items():
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_filter_and_columns_reach_the_scan(spark):
    p = plan(E.queries()["transcriptions"](spark, SF))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p
    assert "ReadSchema: struct<role:string,text:string>" in p


def test_capped_windows_limit_before_the_shuffle(spark):
    for name in ("category_cap", "sample"):
        p = plan(E.queries()[name](spark, SF))
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_dictionary_conversion_shuffles_no_lines(spark):
    p = plan(E.queries()["dictionary_convert"](spark, SF))
    assert "ArrowEvalPython" in p and "Exchange" not in p


def test_split_neither_shuffles_nor_ranks_rows(spark):
    p = plan(E.queries()["split_exact"](spark, SF))
    assert "Exchange" not in p and "Window" not in p
