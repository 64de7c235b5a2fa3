"""Every registered query against its DuckDB oracle (the driver's gate),
plus a row-producing run of the rows-only ones."""

import pytest

from conftest import SF_CHECK, SF_SMALL
from oracle_harness import compare, duck
from quarry.plans.registry import load_all

REGISTRY = load_all()
WITH_ORACLE = sorted(n for n, q in REGISTRY.items() if q.oracle)
ROWS_ONLY = sorted(n for n, q in REGISTRY.items() if not q.oracle)


@pytest.fixture(scope="module")
def con_small():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_oracle(spark, con_small, name):
    problems, _ = compare(REGISTRY[name].build(spark, SF_SMALL), con_small, REGISTRY[name].oracle)
    assert not problems, problems


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) == len(set(df.columns))


@pytest.mark.parametrize("name", ["breakdown_by_type", "task_report", "text_search",
                                  "vector_topk_batch", "markdown_profile"])
def test_matches_oracle_sf001(spark, name):
    problems, n = compare(REGISTRY[name].build(spark, SF_CHECK), duck(SF_CHECK),
                          REGISTRY[name].oracle)
    assert not problems, problems
    assert n > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
