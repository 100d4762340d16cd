"""No join sends a table that grows with the catalog or the inventory through the driver, whatever the planner takes it for."""

import re

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tallyforge.operators.candidates import placed
from tallyforge.plans import more_queries as Q
from tallyforge.plans.catalog import files

#: Of the catalog's own groups one row per brand is sent; these are all that may be.
ALLOWED = r"HashAggregate\(keys=\[parent_key|SortAggregate\(key=\[parent_key|supplier.parquet"
NAMES = """archive_hashes choose_inputs clean_plan combined_zip console_summary dat_combine emptied_folders empty_roms fixdat match_multi_digest
merge_split missing_deps move_delete_plan moved_inputs output_dirs patch_join percent_bands playlist writable write_plan""".split()


def _depth(line):
    return len(re.match(r"[\s:|+\-]*", line).group())


def broadcasts(plan):
    """The part of the plan below each broadcast."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if _depth(lines[j]) <= _depth(line)), len(lines))
            yield "\n".join(lines[i + 1 : end])


@pytest.mark.parametrize("name", NAMES)
def test_nothing_large_is_broadcast(spark, name):
    plan = Q.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [x for x in broadcasts(plan.partition("== Initial")[0]) if not re.search(ALLOWED, x.splitlines()[0] + x[-400:])] == []


def test_places_over_several_ranges(spark):
    rows = spark.range(500).selectExpr("id", "id * 7919 % 500 as x")
    found = placed(rows.repartition(5), [F.col("x"), F.col("id")])
    assert sorted((r["x"], r["place"]) for r in found.collect()) == [(i, i + 1) for i in range(500)]


def test_files_without_a_key_come_once(spark, tmp_path):
    """A line item that differs only in what its row of the inventory does not show is no second file."""
    part = spark.read.parquet(f"{DATA}/sf0.001/part.parquet").where("p_partkey = 1")
    line = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").limit(1).withColumns({"l_partkey": F.lit(1).cast("long"), "l_linenumber": F.lit(2), "l_suppkey": F.lit(None).cast("long"), "l_linestatus": F.lit("F")})
    part.write.parquet(str(tmp_path / "part.parquet"))
    line.union(line.withColumn("l_orderkey", F.col("l_orderkey") + 1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r["path"], r["archive"], r["entry"]) for r in files(spark, str(tmp_path)).collect()] == [(None, None, "part-1-2.rom")]
    assert files(spark, str(tmp_path), once=False).count() == 2
