"""Catalogs of which one has numbers of another's games."""

import duckdb
from oracle import DATA, rows
from pyspark.sql import functions as F

from tallyforge.operators import sets as S
from tallyforge.plans import more_queries as Q


def test_catalogs_that_number_their_games_alike(spark):
    games = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "none"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (1, 4, "none"), (2, 1, "a")], "dat int, game_ord long, name string")
    contents = {(0, 1): "xy", (0, 2): "z", (1, 1): "z", (1, 2): "yx", (1, 3): "z", (2, 1): "x"}
    roms = spark.createDataFrame([(*k, x) for k, v in contents.items() for x in v], "dat int, game_ord long, rom_hash string")
    kept = S.combine(games, roms, ("dat", "game_ord"))
    assert sorted(map(tuple, kept.collect())) == [(0, 1, "a"), (0, 2, "b"), (0, 3, "none"), (1, 3, "c"), (2, 1, "a")]


def test_same_as_sql_where_numbers_overlap(spark, tmp_path):
    """The second catalog's numbers are those of the first and a million, which the first has, too."""
    part = spark.read.parquet(f"{DATA}/sf0.001/part.parquet")
    shifts = F.explode(F.array(*[F.lit(n) for n in (0, 1_000_000, 1_999_900, 3_000_000)]))
    part.withColumn("_shift", shifts).withColumn("p_partkey", F.col("p_partkey") + F.col("_shift")).drop("_shift").write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = c.execute(Q.ORACLES["dat_combine"])
    names = [x[0] for x in want.description]
    found = Q.QUERIES["dat_combine"](spark, str(tmp_path))
    want, got = rows(names, want.fetchall()), rows(found.columns, found.collect())
    assert len(want) > 800 and got == want
