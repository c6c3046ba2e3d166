"""The driver contract: entry() runs, every query has a name-aligned oracle
(or is knowingly rows-only), and all queries equal their DuckDB SQL on sf0.001."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from emberline.plans import catalog

ROWS_ONLY: set[str] = set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["prompt_id", "sample", "generated_text", "finish_reason", "num_tokens"]
    assert df.count() == 200


def test_oracle_coverage():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    q, o = catalog.QUERIES, catalog.ORACLE
    assert set(q) <= set(entry.queries())
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY


@pytest.fixture(scope="module")
def duck():
    from oracle_check import duck as make
    return make(SF_SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import compare
    res = compare(spark, duck, SF_SMALL, name)
    plan = res.pop("_plan")
    assert res["status"] in ("MATCH", "rows-only"), res
    # no query pairs every row with every row
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    if name in ROWS_ONLY:
        assert res["spark_rows"] > 0
