"""Chains of any length."""

from tallyforge.operators import sets as S


def test_long_chain_has_a_root_and_a_circle_none(spark):
    rows = [(i, i - 1 if i else None) for i in range(150)] + [(1000 + i, 1000 + (i + 1) % 3) for i in range(3)]
    got = {r["game_ord"]: r["root"] for r in S.roots(spark.createDataFrame(rows, "game_ord long, rom_of long")).collect()}
    assert got == {i: 0 if i < 1000 else None for i, _ in rows}
