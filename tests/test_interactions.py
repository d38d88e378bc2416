"""Interactions as one record each."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lensmere.operators import safety
from lensmere.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_one_record_each(spark):
    kind = ("query_id int, query string, text string, ts string, session_id string, confidence double, sources long, error boolean, "
            "has_summary boolean, has_conditions boolean, has_actions boolean, has_disclaimer boolean")
    rows = [(i, "plain question", "Longer answer words repeated", f"t{i:03}", "busy", 0.6, 2, False, True, True, False, None) for i in range(7)]
    rows += [(7, "crushing chest pain now", None, "t007", None, None, None, None, None, None, None, None), (8, None, "", "t008", None, 0.9, 9, False, True, True, True, True)]
    df = spark.createDataFrame(rows, kind)
    passages = spark.createDataFrame([(0, r, "Longer answer words stand here", s) for r, s in enumerate(["a", None, "c", "d", "e", "f"], 1)],
                                     "query_id int, rank int, text string, source string")
    both = df.filter("query_id <> 6").unionByName(safety.fallback(df.filter("query_id = 6")))
    got = {r.query_id: r for r in safety.interactions(both, passages, F.lit(0), max_queries=5).collect()}
    assert sorted(got) == list(range(9))
    assert [got[i].session_count for i in range(7)] == list(range(1, 8)) and got[6].requires_review and not got[4].requires_review
    assert got[7].session_id == "anonymous" and got[7].risk_level == "critical" and got[8].session_count == 2
    assert got[0].query_hash == hashlib.md5(b"plain question").hexdigest() and got[0].common == 3
    assert got[0].citations == ["Reference [0]: a", "Reference [1]: Unknown", "Reference [2]: c", "Reference [3]: d", "Reference [4]: e"] and got[1].citations is None
    assert got[6].relevance == got[6].completeness == got[6].clarity == 0.0 and got[6].sources_used == 0 and got[6].risk_level == "medium"
    assert got[8].overall == 0.9425 and got[0].relevance == round(2 / 3 * .5 + .6 * .3 + 2 / 3 * .2, 6)
