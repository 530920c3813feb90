"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from sieveloom.plans.registry import ORACLES, QUERIES
from tests.compare import rows, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name], sf)
    else:
        assert rows(df)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_lint_is_one_scan_without_python(spark, sf):
    plan = QUERIES["flagship_corpus_lint"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "MapInArrow" not in plan
    assert "page_id" in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan.replace(",url:string", "")
