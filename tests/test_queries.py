"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, differences

from nearfield.plans import catalogue, runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    found = catalogue.QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(found, catalogue.ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_result_files_of_small_blocks(spark, con, monkeypatch):
    """However events are cut into results and files, the numbers stay."""
    monkeypatch.setattr(runs, "_RESULT_QUERIES", 10)
    monkeypatch.setattr(runs, "_FILE_USERS", 7)
    name = "AG18_from_result_files"
    assert differences(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], con) == []
