import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import run_query  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from reportlake import queries as core  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, name):
    df = core.QUERIES[name](spark, SMALL).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = run_query.oracle(SMALL).sql(sql).df()
        assert sorted(df.columns) == sorted(want.columns)
        assert run_query.canonical(df) == run_query.canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
