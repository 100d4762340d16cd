import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import names as N
from tallyforge.functions import text as X
from tallyforge.operators import games as G
from tallyforge.plans.options import Options


def each(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_revision(spark):
    names = ["A (Rev 2)", "A (Rev B)", "A v1.011 (x)", "A (RE125)", "A (RE)", "A (Rev 1.2.3)", "A"]
    assert each(spark, N.revision, names) == [2, 2, 1.011, 125, 1, 0, 0]


def test_regions_and_languages(spark):
    names = ["A (Japan, USA) (En)", "Tetris (World) (Rev 1)", "A (J)", "A (C)", "A (F)", "A (Scandinavia)", "A"]
    assert each(spark, N.regions, names) == [["JPN", "USA"], ["WORLD"], ["JPN"], ["CAN"], ["FRA"], [""], []]
    names = ["A (Japan) (En) (Rev 1)", "A (En,Fr,De)", "A (Ger-Fre)", "A (Europe)", "A (pt-BR)", "A"]
    assert each(spark, lambda x: N.languages(x, N.regions(x)), names) == [["EN"], ["EN", "FR", "DE"], ["DE", "FR"], ["EN"], ["PT"], []]


@pytest.mark.parametrize(
    ("name", "kind"),
    [("[BIOS] A", "BIOS"), ("A [!] (Beta)", "Retail"), ("A (Beta 2)", "Beta"), ("A [b1]", "Bad"), ("A (Kiosk)", "Demo"), ("A [h1C]", "Hacked"), ("A [T+Eng]", "Translated"), ("A (Unl)", "Unlicensed"), ("A [!p]", "Pending Dump"), ("A", "Retail"), ("A (Alt 1)", "Retail")],
)
def test_game_type(spark, name, kind):
    row = G.with_names(spark.createDataFrame([(0, name)], "game_ord int, name string")).first()
    assert row["game_type"] == kind


def test_bad_needs_no_verification(spark):
    rows = G.with_names(spark.createDataFrame([("A [c]",), ("A [c][!]",), ("A [b][!]",)], "name string")).select("is_bad").collect()
    assert [r[0] for r in rows] == [True, False, True]


def test_strip(spark):
    names = ["Sonic (USA, Europe) (En,Fr) (Rev 1)", "A (Japan) (Demo) [!]", "B's '99 (Disc 1)"]
    assert each(spark, lambda x: N.strip_variants(N.strip_region_language(x)), names) == ["Sonic", "A", "B's 99 (Disc 1)"]
    assert each(spark, N.strip_disc, ["A (Disc 1)", "A (Disk 2 of 3) (Track 04)", "A"]) == ["A", "A", "A"]


def test_parents_inferred(spark):
    games = spark.createDataFrame([(0, "A (Japan)"), (1, "A (USA) (Beta)"), (2, "A (USA)"), (3, "B (Demo)"), (4, "B (Proto)")], "game_ord int, name string")
    rows = {r["game_ord"]: r["clone_of"] for r in G.infer_parents(games).collect()}
    assert rows == {0: None, 1: "A (Japan)", 2: "A (Japan)", 3: None, 4: "B (Demo)"}


def test_preference_ties_go_on(spark):
    games = G.with_names(spark.createDataFrame([(0, "A (Europe) (Rev 1)", "A"), (1, "A (Europe) (Rev 2)", "A"), (2, "A (Japan)", "A")], "game_ord int, name string, parent_key string").withColumn("clone_of", F.lit(None).cast("string")))
    best = G.prefer(games, Options(input=("x",), single=True, prefer_region=("EUR", "USA"), prefer_revision="newer")).collect()
    assert [r["game_ord"] for r in best] == [1]


def test_filter_elects_the_first_left(spark):
    rows = [(0, "A (Beta)", "A", None), (1, "A (USA)", "A", "A (Beta)"), (2, "A (Japan)", "A", "A (Beta)")]
    games = G.with_names(spark.createDataFrame(rows, "game_ord int, name string, parent_key string, clone_of string"))
    left = {r["game_ord"]: r["clone_of"] for r in G.filter_games(games, Options(no=frozenset({"beta"}))).collect()}
    assert left == {1: None, 2: "A (USA)"}


def test_text(spark):
    assert each(spark, lambda x: X.hex_key(x, 8), ["0xABC", "12345678", "123456789"]) == ["00000abc", "12345678", "123456789"]
    assert each(spark, X.readable_size, [0, 1023, 1024, 1536, 15_000, 1_500_000_000, 120_000], "long") == ["0B", "1023B", "1KiB", "1.50KiB", "14.6KiB", "1.40GiB", "117KiB"]
    assert each(spark, X.make_legal, ["a:b", "a\\b?c"]) == ["a;b", "a/b_c"]
    assert each(spark, X.crc_in_name, ["p/x 0361b321.ips", "[F817A89F] y.bps", "none.ups"]) == ["0361b321", "f817a89f", None]
    assert each(spark, X.patched_name, ["p/x 0361b321 y.ips"]) == ["x y"]
    assert each(spark, X.display_name, ["- A - - B -"]) == ["A - B"]
    assert each(spark, lambda x: X.replace_literal_first(x, "{a}", F.lit("$1\\")), ["x{a}{a}", "none"]) == ["x$1\\{a}", "none"]
    assert X.regex_list("/ab/i\ncd") == "(?:(?i)ab)|(?:cd)"
    import re

    assert [bool(re.match(X.glob_regex(g), p)) for g, p in (("*.nes", "a.nes"), ("*.nes", "d/a.nes"), ("**/*.{nes,gb}", "d/e/a.gb"), ("[!a].x", "b.x"))] == [True, False, True, True]
    assert X.format_dates("r_%YYYY-%MM-%DD.csv", dt.datetime(2024, 3, 5)) == "r_2024-03-05.csv"


def test_options_are_checked():
    for wrong in ({"copy", "move"}, {"zip"}, {"clean"}, {"fly"}):
        with pytest.raises(ValueError):
            Options(commands=frozenset(wrong))
    assert Options(commands=frozenset({"copy", "zip", "clean"})).writes
