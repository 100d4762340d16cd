"""Every query against its SQL, on the smallest tables."""

import pytest
from oracle import DATA, connect, differences

from tallyforge.plans import more_queries as Q
from tallyforge.plans.queries import _files_left, best, statuses

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, name):
    found = Q.QUERIES[name](spark, FOLDER)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(found, Q.ORACLES[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_gives_rows(name):
    """So equal results are not both empty."""
    assert connect(FOLDER).execute(Q.ORACLES[name]).fetchone()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_has_rows(spark, name):
    assert Q.QUERIES[name](spark, FOLDER).head(1)


def test_every_game_has_one_status_and_every_file_one_use(spark):
    found = {r["status"]: r["count"] for r in statuses(spark, FOLDER).groupBy("status").count().collect()}
    assert found == {"FOUND": 151, "INCOMPLETE": 20, "MISSING": 29}
    left = {r["status"]: r["count"] for r in _files_left(spark, FOLDER).groupBy("status").count().collect()}
    used = best(spark, FOLDER).select("path").distinct().count()
    assert (used, left["DUPLICATE"], left["UNUSED"]) == (328, 2906, 1424)
