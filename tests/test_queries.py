from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from lakelens.plans.oracles import ORACLES
from lakelens.plans.queries import QUERIES

pytestmark = pytest.mark.skipif(not Path(oracle.FOLDER).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, oracle.FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["project_id", "ref", "path", "snapshot_no", "change_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
