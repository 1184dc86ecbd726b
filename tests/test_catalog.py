"""Every registered query on the smallest tables: same rows as its SQL, and a plan without nested loops."""

import re

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from khata.catalog import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, con, name):
    frame = entry.queries()[name](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        frame.collect()
    else:
        assert differences(frame, con, sql) == ""


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.filter("NOT closes").isEmpty() and "remainder_paise" in frame.columns


def test_every_query_is_registered():
    assert set(NAMES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_most_queries_have_sql():
    lacking = set(NAMES) - set(entry.oracle_sql())
    assert lacking <= {"f15_document_figures", "j1f_greedy", "x11_greedy_against_careful", "s14_pack_heads", "a15_pooled_coverage"}


def test_type_filter_reaches_the_scan(ledger):
    from khata.operators.select import select

    plan = select(ledger.events, "captures")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,payment_captured)" in plan
