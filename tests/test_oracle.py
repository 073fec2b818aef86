"""Every registered query against its SQL, on whole tables."""

import pytest

from filigree.plans.oracle import ORACLE
from filigree.plans.registry import REGISTRY

def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value if value is None or isinstance(value, (str, bool, int)) else str(value)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_equal_rows(spark, duck, sf_dir, name):
    df = REGISTRY[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert found == wanted
    assert found, "an empty result proves nothing"


VARYING = {
    "route_query": "to_agent", "flag_complex_query": "is_complex", "tag_topics": "topics",
    "tag_query_patterns": "is_comparison", "history_profile": "topics", "suggest_followups": "suggested_queries",
    "suggest_agent_followups": "suggested_queries", "trace_profile": "topics", "priority_topics": "topics",
}


@pytest.mark.parametrize("name", VARYING)
def test_results_vary(spark, sf_dir, name):
    assert REGISTRY[name](spark, sf_dir).select(VARYING[name]).distinct().count() > 1
