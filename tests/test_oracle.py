"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import oracle
from lensmere.plans.registry import registry

# Fixed names: queries whose meaning SQL cannot state; checked elsewhere.
WITHOUT_SQL = {"reply_repeat_collapse", "reply_opening_echo", "answer_context"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_which_queries_have_no_sql():
    assert {n for n, (_, sql) in registry().items() if sql is None} == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, con, sf, name):
    run, sql = registry()[name]
    rows, expected, problem, *_ = oracle.compare(spark, con, sf, run, sql)
    assert problem is None, problem
    assert rows > 0
