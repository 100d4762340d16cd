"""Whole runs over catalogs and files in folders."""

import dataclasses
import gzip
import hashlib
import zipfile
import zlib

import pytest

from tallyforge.operators.sinks import is_torrentzip
from tallyforge.plans.options import Options
from tallyforge.plans.run import run


def _rom(name, body):
    return f'<rom name="{name}" size="{len(body)}" crc="{zlib.crc32(body):08x}" sha1="{hashlib.sha1(body).hexdigest()}"/>'


@pytest.fixture
def place(tmp_path):
    one, two, both = b"one\n", b"two\n", b"both\n"
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "a.dat").write_text(
        '<?xml version="1.0"?>\n<datafile><header><name>Alpha</name><description>First</description></header>\n'
        f'<game name="One (USA)"><description>One</description>{_rom("one.rom", one)}</game>\n'
        f'<game name="Two (Europe)"><description>Two</description>{_rom("two.rom", two)}{_rom("both.rom", both)}</game>\n'
        f'<game name="Gone"><description>Gone</description>{_rom("gone.rom", b"gone")}</game>\n</datafile>'
    )
    (tmp_path / "b.dat").write_text(
        f'<?xml version="1.0"?>\n<datafile><header><name>Beta</name><description>Second</description></header>\n<game name="One (USA)"><description>x</description>{_rom("uno.rom", one)}</game>\n</datafile>'
    )
    (tmp_path / "in/1.bin").write_bytes(one)
    with zipfile.ZipFile(tmp_path / "in/deep/two.zip", "w") as z:
        z.writestr("two.rom", two)
        z.writestr("x/both.rom", both)
    (tmp_path / "in/other.gz").write_bytes(gzip.compress(b"other"))
    return tmp_path


def _options(place, *commands, **more):
    return Options(commands=frozenset(commands), dat=(str(place / "a.dat"), str(place / "b.dat")), input=(str(place / "in"),), output=str(place / "out"), **more)


def test_extract(spark, place):
    done = run(spark, _options(place, "copy", "extract", dir_dat_name=True, dir_game_subdir="multiple"))
    files = {str(p.relative_to(place / "out")): p.read_bytes() for p in (place / "out").rglob("*") if p.is_file()}
    assert files == {"Alpha/one.rom": b"one\n", "Alpha/Two (Europe)/two.rom": b"two\n", "Alpha/Two (Europe)/both.rom": b"both\n", "Beta/uno.rom": b"one\n"}
    assert {(r["dat_id"], r["name"]): r["status"] for r in done.statuses.collect()} == {("Alpha", "One (USA)"): "FOUND", ("Alpha", "Two (Europe)"): "FOUND", ("Alpha", "Gone"): "MISSING", ("Beta", "One (USA)"): "FOUND"}
    assert [r["path"].rsplit("/", 1)[1] for r in done.leftovers.where("status = 'UNUSED'").collect()] == ["other.gz"]


def test_zip_report_fixdat_and_clean(spark, place):
    (place / "out").mkdir()
    (place / "out/stale.txt").write_text("x")
    run(spark, _options(place, "copy", "zip", "report", "fixdat", "clean", report_output=str(place / "report"), fixdat_output=str(place / "fix"), dat_name_regex="^Al"))
    zips = sorted(p.name for p in (place / "out").iterdir())
    assert zips == ["One (USA).zip", "Two (Europe).zip"]
    body = (place / "out/Two (Europe).zip").read_bytes()
    assert is_torrentzip(body) and sorted(zipfile.ZipFile(place / "out/Two (Europe).zip").namelist()) == ["both.rom", "two.rom"]
    report = "".join(p.read_text() for p in (place / "report").glob("*.csv"))
    assert "Alpha,Gone,MISSING" in report and "other.gz" in report and "\nBeta," not in report
    text = (place / "fix/Alpha.dat").read_text()
    assert '<game name="Gone">' in text and "One (USA)" not in text


def test_move_links_and_preferences(spark, place):
    run(spark, _options(place, "move", "extract", dat_combine=True))
    assert not (place / "in/1.bin").exists() and not (place / "in/deep/two.zip").exists() and (place / "in/other.gz").exists()
    assert not (place / "in/deep").exists() and (place / "in").exists()


def test_move_leaves_what_it_does_not_write(spark, place):
    (place / "out").mkdir()
    (place / "out/one.rom").write_bytes(b"another")
    run(spark, _options(place, "move", "extract", dat_name_regex="^Al", dir_game_subdir="never"))
    assert (place / "in/1.bin").read_bytes() == b"one\n" and (place / "out/one.rom").read_bytes() == b"another"
    assert not (place / "in/deep").exists() and (place / "out/two.rom").read_bytes() == b"two\n"


def test_console_tokens(spark, place):
    (place / "tokens.json").write_text('{"consoles": [{"datRegex": "^Al", "extensions": [".x"], "tokens": {"sys": "A"}}, {"datRegex": "none", "extensions": [".rom"], "tokens": {"sys": "B"}}]}')
    options = _options(place, "copy", "extract", dir_game_subdir="never", output_console_tokens=str(place / "tokens.json"))
    run(spark, dataclasses.replace(options, output=str(place / "out/{sys}")))
    assert sorted(str(p.relative_to(place / "out")) for p in (place / "out").rglob("*.rom")) == ["A/both.rom", "A/one.rom", "A/two.rom", "B/uno.rom"]


def test_dir2dat(spark, place):
    run(spark, _options(place, "dir2dat", dir2dat_output=str(place / "made")))
    text = (place / "made/in.dat").read_text()
    assert '<game name="two">' in text and 'name="x/both.rom"' in text and f'crc="{zlib.crc32(b"other"):08x}"' in text
