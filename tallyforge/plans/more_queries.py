"""Further queries over the catalog views: texts, scans, headers, candidates, sets and paths, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import names as N
from tallyforge.functions import text as T
from tallyforge.functions import vocab as V
from tallyforge.operators import candidates as C
from tallyforge.operators import games as G
from tallyforge.operators import infer as I
from tallyforge.operators import paths as P
from tallyforge.operators import reports as R
from tallyforge.operators import sets as S
from tallyforge.operators import sinks as W
from tallyforge.operators.matching import archives_need_checksums, empty_files
from tallyforge.plans import catalog as K
from tallyforge.plans.options import Options
from tallyforge.operators import matching as M
from tallyforge.plans.queries import BEST, DIVIDED, FILES, FLAGGED, GAMES, ROMS, TALKED, _entries, _keys, _order, _q, best, named, query, statuses
from tallyforge.plans.queries import ORACLES, QUERIES, _refs
from tallyforge.plans.reconcile import reconcile
from tallyforge.sources import archives as A
from tallyforge.sources import catalogs as X
from tallyforge.sources import signatures as H


__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _of(words: list, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


def _sql_of(words: list[str], key: str) -> str:
    return "[" + ", ".join(map(_q, words)) + f"][({key} % {len(words)} + 1)::INT]"


# Texts and names


_TRACK_SQL = "name"
for _p in V.TRACK_TAGS:
    _TRACK_SQL = f"regexp_replace({_TRACK_SQL}, {_q(_p)}, '')"


@query(f" SELECT game_ord, {_TRACK_SQL} AS bare FROM games", (GAMES,))
def strip_track(spark: SparkSession, d: str) -> DataFrame:
    return K.games(spark, d).select("game_ord", N.strip_track(F.col("name")).alias("bare"))


_DASHES = ["- {} -", "{} -  - x", "  {}  ", "-- {} - - - y -", "{}", " - {}   z"]


@query(
    "WITH n AS (SELECT c_custkey, replace(" + _sql_of(_DASHES, "c_custkey") + ", '{}', c_name) AS raw FROM customer) SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '-( +-)+', '- ', 'g'), '^[ -]+', ''), '[ -]+$', ''), '  +', ' ', 'g')) AS shown FROM n"
)
def display_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace(_of(_DASHES, F.col("c_custkey")), F.lit("{}"), F.col("c_name"))
    return _table(spark, d, "customer").select("c_custkey", T.display_name(raw).alias("shown"))


@query(
    r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ': a/b' ELSE p_name || ' "?"' END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR WHEN p_partkey % 5 = 0 THEN '' END AS version FROM part)
  SELECT p_partkey, replace(regexp_replace(replace(trim(CASE WHEN coalesce(version, '') <> '' THEN name || ' (' || version || ')' ELSE name END || '.dat'), ':', ';'), '[<>"|?*]', '_', 'g'), '\', '/') AS file FROM n"""
)
def catalog_filenames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(": a/b"))).otherwise(F.concat("p_name", F.lit(' "?"')))
    version = F.when(k % 2 == 0, F.col("p_size").cast("string")).when(k % 5 == 0, "")
    return _table(spark, d, "part").select("p_partkey", T.catalog_filename(name, version).alias("file"))


@query(
    """WITH s AS (SELECT p_partkey, ((p_partkey * 7919) % 97 + 1) * pow(10, p_partkey % 14)::BIGINT * 2 + 1 AS size FROM part),
  v AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < pow(1024, 2) THEN 1 WHEN size < pow(1024, 3) THEN 2 WHEN size < pow(1024, 4) THEN 3 WHEN size < pow(1024, 5) THEN 4 ELSE 5 END AS step FROM s),
  w AS (SELECT *, size / pow(1024, step) AS x FROM v)
  SELECT p_partkey, size, CASE WHEN x = floor(x) THEN printf('%.0f', x) WHEN x < 10 THEN printf('%.2f', x) WHEN x >= 100 OR length(printf('%.1f', x)) >= 5 THEN printf('%.0f', x) ELSE printf('%.1f', x) END || ['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'][step + 1] AS shown FROM w"""
)
def readable_sizes(spark: SparkSession, d: str) -> DataFrame:
    size = ((F.col("p_partkey") * 7919) % 97 + 1) * F.pow(F.lit(10), F.col("p_partkey") % 14).cast("long") * 2 + 1
    return _table(spark, d, "part").select("p_partkey", size.alias("size")).select("p_partkey", "size", T.readable_size(F.col("size")).alias("shown"))


_PATCHES = ["p/{n} [{c}].ips", "p/{n}.{c}.bps", "p/0x{c} {n}.ups", "p/{n}.ppf", "{c}/{n}.ips", "p/{n} {c}0.ips"]
_PATCH_SQL = "replace(replace(" + _sql_of(_PATCHES, "p_partkey") + ", '{n}', p_name), '{c}', upper(md5(p_name)[1:8]))"


@query(
    rf"""WITH n AS (SELECT p_partkey, {_PATCH_SQL} AS path FROM part), b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM n),
  c AS (SELECT *, lower(nullif(regexp_extract(base, '(?i)(^|[^a-z0-9])(0x)?([a-f0-9]{{8}})([^a-z0-9]|$)', 3), '')) AS crc FROM b)
  SELECT p_partkey, crc, trim(regexp_replace(CASE WHEN crc IS NULL THEN regexp_replace(base, '^(.+)\.[^.]*$', '\1') ELSE regexp_replace(regexp_replace(base, '^(.+)\.[^.]*$', '\1'), '(?i)' || crc, '', 'g') END, '  +', ' ', 'g')) AS name FROM c"""
)
def patch_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.replace(F.replace(_of(_PATCHES, F.col("p_partkey")), F.lit("{n}"), F.col("p_name")), F.lit("{c}"), F.upper(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 8)))
    return _table(spark, d, "part").select("p_partkey", T.crc_in_name(path).alias("crc"), T.patched_name(path).alias("name"))


@query(" SELECT game_ord, name FROM games WHERE regexp_matches(name, '(?i)small.*usa|Blue|^red')", (GAMES,))
def regex_list(spark: SparkSession, d: str) -> DataFrame:
    return K.games(spark, d).where(F.col("name").rlike(T.regex_list("/small.*usa/i\nBlue\n\n  /^red/i  ".replace("Blue", "/blue/i")))).select("game_ord", "name")


@query(r" SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(in|out)/(.*/)?[^/]*-[1-3]-[^/]*\.(zip|7z)$')", (FILES,))
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.files(spark, d).select("path").distinct().where(F.col("path").rlike(T.glob_regex("{in,out}/**/*-[1-3]-*.{zip,7z}")))


# Scans


@query(" SELECT min(path) AS path, sha1 AS file_hash FROM files GROUP BY sha1", (FILES,))
def unique_files(spark: SparkSession, d: str) -> DataFrame:
    return A.unique_files(K.files(spark, d).select("path", F.col("sha1").alias("file_hash")))


@query(" SELECT path, bool_or(NOT in_output) AS can_be_input FROM (SELECT path, in_output FROM files WHERE NOT in_output OR path NOT IN (SELECT path FROM files WHERE NOT in_output)) GROUP BY path", (FILES,))
def inputs_and_outputs(spark: SparkSession, d: str) -> DataFrame:
    files = K.files(spark, d)
    return A.with_output_files(files.where("not in_output").select("path").distinct(), files.where("in_output").select("path").distinct())


_JUNK = ["/.DS_Store", "/Thumbs.db", "/game.rom", "/._game.rom", "/notes~", "/desktop.ini", "/Icon"]


@query(" SELECT s_suppkey, s_name || " + _sql_of(_JUNK, "s_suppkey") + " AS path FROM supplier WHERE s_suppkey % 7 IN (2, 6)")
def junk_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", _of(_JUNK, F.col("s_suppkey"))).alias("path"), F.lit(None).cast("string").alias("entry"))
    return A.without_junk(rows).select("s_suppkey", "path")


@query(" SELECT DISTINCT 'in/' || l_suppkey AS dir FROM _l WHERE l_linestatus = 'F'", (FILES,))
def input_folders(spark: SparkSession, d: str) -> DataFrame:
    return A.folders_below(K.files(spark, d), ["in"])


@query(
    BEST + """, gone AS (SELECT DISTINCT path FROM files WHERE NOT in_output AND (regexp_matches(path, '^in/[0-9]*[147]/') OR path IN (SELECT path FROM best)))
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM files WHERE NOT in_output GROUP BY 1 HAVING bool_and(path IN (SELECT path FROM gone))""",
    (GAMES, ROMS, FILES),
)
def emptied_folders(spark: SparkSession, d: str) -> DataFrame:
    files = K.files(spark, d).where("not in_output").select("path").distinct()
    gone = files.where(F.col("path").rlike("^in/[0-9]*[147]/")).union(files.join(best(spark, d).select("path"), "path", "left_semi")).distinct()
    return A.emptied_folders(files, gone, ["in"])


_HEADS = [("NES\x1a", 16, ".nes", "No-Intro_NES.xml"), ("LYNX", 64, ".lyx", "No-Intro_LNX.xml"), ("FDS", 16, ".fds", "No-Intro_FDS.xml"), ("none", 0, None, None)]


def _headered(spark: SparkSession, d: str) -> DataFrame:
    heads = [head.ljust(size, ".") for head, size, _, _ in _HEADS]
    return _table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(_of(heads, F.col("doc_id")), F.col("text")).cast("binary").alias("content"))


_HEAD_SQL = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN rpad({_q(h[:3]) + ' || chr(26)' if h[3:] == chr(26) else _q(h)}, {max(n, 4)}, '.')" for i, (h, n, _, _) in enumerate(_HEADS)) + " END"


@query(
    f"""WITH c AS (SELECT doc_id, {_HEAD_SQL} || text AS content, doc_id % 4 <> 3 AS headed, text FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, {_sql_of([x[3] or '' for x in _HEADS], 'doc_id')} AS header, {_sql_of([x[2] or '' for x in _HEADS], 'doc_id')} AS ext, CASE WHEN headed THEN strlen(text) END AS size_wo, CASE WHEN headed THEN md5(text) END AS md5_wo, CASE WHEN headed THEN sha1(text) END AS sha1_wo, CASE WHEN headed THEN sha256(text) END AS sha256_wo FROM c"""
)
def header_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = H.with_headers(_headered(spark, d))
    return rows.select("doc_id", F.coalesce("header.name", F.lit("")).alias("header"), F.coalesce("header.headerless_ext", F.lit("")).alias("ext"), "size_wo", "md5_wo", "sha1_wo", "sha256_wo")


_EXTENSIONS = [".nes", ".rom", ".a78", ".smc", ".fds", ".bin", ".lnx"]


@query("SELECT p_partkey, (p_partkey % 11 > 0) AND (p_partkey % 7 IN (0, 2, 3, 4, 6) OR p_partkey % 5 = 0) AS headed, (p_size > 0) AND p_size NOT IN (1, 2, 4, 8, 16, 32, 64) AS trimmed FROM part")
def scan_eligibility(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, d, "part").select("p_partkey", H.may_have_header(_of(_EXTENSIONS, k), k % 11, k % 5 == 0).alias("headed"), H.may_be_trimmed(F.col("p_size").cast("long")).alias("trimmed"))


@query(
    r"""WITH c AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''), s AS (SELECT *, pow(2, ceil(log2(n)))::BIGINT AS size FROM c),
  p AS (SELECT *, unnest([0, 255]) AS fill FROM s WHERE size > n), b AS (SELECT *, encode(text) || repeat(CASE fill WHEN 0 THEN '\x00'::BLOB ELSE '\xFF'::BLOB END, size - n) AS body FROM p)
  SELECT doc_id, size AS padded_size, fill AS fill_byte, md5(body) AS md5, sha1(body) AS sha1, sha256(body) AS sha256 FROM b"""
)
def padding_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    rows = H.with_signatures(docs, paddings=True).select(F.col("path").cast("long").alias("doc_id"), F.explode("paddings").alias("p"))
    return rows.select("doc_id", "p.padded_size", "p.fill_byte", "p.md5", "p.sha1", "p.sha256")


def _laid_out(pieces: list[tuple[int, bytes]]) -> bytes:
    body = bytearray(max(at + len(v) for at, v in pieces))
    for at, v in pieces:
        body[at : at + len(v)] = v
    return bytes(body)


@query("SELECT doc_id, " + _sql_of([ext for ext, _ in H.SIGNATURES], "doc_id") + " AS signature FROM documents")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    """A document after the bytes of each signature in turn; every row of the table of signatures comes."""
    heads = [_laid_out(pieces) for _, pieces in H.SIGNATURES]
    docs = _table(spark, d, "documents").select("doc_id", F.concat(_of(heads, F.col("doc_id")), F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("content"))
    rows = H.with_signatures(docs.select(F.col("doc_id").cast("string").alias("path"), "content"))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "signature")


@query(
    "SELECT n_nationkey, bool_or(regexp_matches(lower(p_name || " + _sql_of([".rom", ".zip", ".7z", ".bin", ".chd", ".txt"], "p_partkey") + "), '\\.(zip|7z|chd)$')) AS needed FROM part JOIN nation ON p_partkey % 25 = n_nationkey AND p_partkey % 6 IN (0, 3, 5, n_nationkey % 6) GROUP BY 1"
)
def archive_checksums(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _table(spark, d, "part").select((k % 25).alias("n_nationkey"), F.concat("p_name", _of([".rom", ".zip", ".7z", ".bin", ".chd", ".txt"], k)).alias("name"), (k % 6).alias("k")).where("k in (0, 3, 5) or k = n_nationkey % 6")
    return archives_need_checksums(rows, by=["n_nationkey"])


# Catalogs


def _headers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _table(spark, d, "nation").select(k.alias("dat_id"), F.col("n_name").alias("name"), F.when(k % 4 > 0, F.concat(F.lit("about "), "n_name")).alias("description"))


@query("SELECT n_nationkey AS dat_id FROM nation WHERE regexp_matches(n_name, '[AI]') AND NOT regexp_matches(n_name, '^C') AND (n_nationkey % 4 = 0 OR (regexp_matches(n_name, 'A|1|2') AND NOT regexp_matches('about ' || n_name, 'R|9')))")
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.keep_catalogs(_headers(spark, d), "[AI]", "^C", "A|1|2", "R|9").select("dat_id")


@query(
    """WITH rom_x AS (SELECT o_orderkey % 40 AS dat_id, 'g' || CASE WHEN o_orderkey % 40 < 20 THEN 0 ELSE o_orderkey % 3 END AS game, o_orderkey % 40 % 3 <> 0 AS bios, 'rom' || (o_orderkey // 40 % 13) || '.bin' AS rom FROM orders),
  one_x AS (SELECT dat_id, count(DISTINCT game) = 1 AND bool_and(bios) AND count(*) > 10 AS split FROM rom_x GROUP BY 1),
  parts AS (SELECT dat_id, game, rom FROM rom_x JOIN one_x USING (dat_id) WHERE NOT split UNION ALL SELECT DISTINCT dat_id, regexp_replace(rom, '\\.[^./]*$', ''), rom FROM rom_x JOIN one_x USING (dat_id) WHERE split)
  SELECT dat_id, game, count(*) AS n_roms FROM parts GROUP BY 1, 2"""
)
def bios_packs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _table(spark, d, "orders").select((k % 40).alias("dat_id"), F.concat(F.lit("g"), F.when(k % 40 < 20, 0).otherwise(k % 3)).alias("name"), (k % 40 % 3 != 0).alias("is_bios"), F.concat(F.lit("rom"), F.floor(k / 40) % 13, F.lit(".bin")).alias("rom"))
    games = rows.groupBy("dat_id", "name").agg(F.bool_and("is_bios").alias("is_bios"), F.collect_list(F.struct(F.col("rom").alias("name"))).alias("roms"))
    return X.one_game_per_bios(games).select("dat_id", F.col("name").alias("game"), F.size("roms").cast("long").alias("n_roms")).groupBy("dat_id", "game").agg(F.sum("n_roms").alias("n_roms"))


@query(FLAGGED + """, st AS (SELECT game_ord // 8 AS dat_id, game_ord, CASE WHEN game_ord % 8 = 3 AND is_retail THEN 'FOUND' ELSE 'MISSING' END AS status FROM flagged)
  SELECT dat_id, game_ord, status FROM st WHERE dat_id IN (SELECT dat_id FROM st WHERE status = 'FOUND')""", (GAMES,))  # fmt: skip
def reported_catalogs(spark: SparkSession, d: str) -> DataFrame:
    rows = named(spark, d).select(F.floor(F.col("game_ord") / 8).alias("dat_id"), "game_ord", F.when((F.col("game_ord") % 8 == 3) & F.col("is_retail"), "FOUND").otherwise("MISSING").alias("status"))
    return W.reported(rows)


# Parents, filters and preferences

_PARENTS = """, p AS (SELECT p_partkey AS game_ord, CASE WHEN p_partkey % 3 = 0 THEN 'i' || (p_partkey % 50) END AS id, CASE WHEN p_partkey % 6 = 3 THEN 'i' || (p_partkey % 64) WHEN p_partkey % 35 = 5 THEN 'i' || (p_partkey % 90) END AS clone_of_id, p_name AS name, CASE WHEN p_partkey % 4 = 1 THEN 'none ' || (p_partkey % 9) WHEN p_partkey % 7 = 2 THEN 'red widget' END AS clone_of FROM part)"""


def _told_parents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    i = lambda n: F.concat(F.lit("i"), k % n)
    return _table(spark, d, "part").select(k.alias("game_ord"), F.when(k % 3 == 0, i(50)).alias("id"), F.when(k % 6 == 3, i(64)).when(k % 35 == 5, i(90)).alias("clone_of_id"), F.col("p_name").alias("name"), F.when(k % 4 == 1, F.concat(F.lit("none "), k % 9)).when(k % 7 == 2, "red widget").alias("clone_of"))


@query(
    "WITH x AS (SELECT 1)" + _PARENTS + """, m AS (
    SELECT game_ord, id, 0 AS step, 'id:' || id AS key FROM p WHERE clone_of_id IS NULL AND id IS NOT NULL
    UNION ALL SELECT game_ord, id, 0, 'name:' || name FROM p WHERE clone_of_id IS NULL AND id IS NULL AND clone_of IS NULL
    UNION ALL SELECT game_ord, id, 1, 'id:' || clone_of_id FROM p WHERE clone_of_id IS NOT NULL
    UNION ALL SELECT game_ord, id, 1, 'name:' || clone_of FROM p WHERE clone_of_id IS NULL AND clone_of IS NOT NULL),
  f AS (SELECT key, min(step * 10000000000 + game_ord) AS first FROM m WHERE step = 0 OR id IS NOT NULL OR starts_with(key, 'name:') GROUP BY 1)
  SELECT key AS parent_key, game_ord, step * 10000000000 + game_ord = first AS is_parent FROM m JOIN f USING (key) WHERE step * 10000000000 + game_ord >= first"""
)
def parent_groups(spark: SparkSession, d: str) -> DataFrame:
    return G.parent_groups(_told_parents(spark, d))


@query(" SELECT game_ord // 4 AS dat_id, count(DISTINCT parent_key) <> count(*) AS has_parents FROM games GROUP BY 1", (GAMES,))
def parent_info(spark: SparkSession, d: str) -> DataFrame:
    return G.has_parent_clone_info(K.games(spark, d).withColumn("dat_id", F.floor(F.col("game_ord") / 4)), ["dat_id"])


_ONLY = {"only_bios": ("bios",), "only_unlicensed": ("unlicensed",), "only_debug": ("debug",), "only_homebrew": ("homebrew",), "only_unverified_bad": ("unverified", "bad"), "only_program": ("program",), "only_aftermarket": ("aftermarket",), "only_demo": ("demo",), "only_beta": ("beta",), "only_sample": ("sample",), "only_prototype": ("prototype",), "only_device": ("device",)}
_is = lambda k: "NOT is_verified" if k == "unverified" else f"is_{k}"
_FLAGS = ["unlicensed", "debug", "beta", "sample", "prototype", "program", "aftermarket", "homebrew", "unverified", "device", "demo", "bad", "bios"]


@query(FLAGGED + " " + " UNION ALL ".join([f"SELECT {_q(k)} AS filter, game_ord FROM flagged WHERE {' AND '.join(map(_is, v))}" for k, v in _ONLY.items()] + [f"SELECT 'no_{k}', game_ord FROM flagged WHERE NOT {_is(k)}" for k in _FLAGS] + ["SELECT 'only_retail', game_ord FROM flagged WHERE is_retail", "SELECT 'category', game_ord FROM flagged WHERE regexp_matches(category, '^(Demos|Appl)')", "SELECT 'name', game_ord FROM flagged WHERE regexp_matches(name, '(?i)BLUE')"]), (GAMES,))
def filter_each(spark: SparkSession, d: str) -> DataFrame:
    """Every filter by itself: the names of the filters and the games that each lets through."""
    rows = named(spark, d)
    options = {k: Options(only=frozenset(v)) for k, v in _ONLY.items()} | {f"no_{k}": Options(no=frozenset({k})) for k in _FLAGS}
    options |= {"only_retail": Options(only_retail=True), "category": Options(filter_category_regex="^(Demos|Appl)"), "name": Options(filter_regex="(?i)BLUE")}
    passed = F.filter(F.array(*(F.when(G.passes(o), F.lit(k)) for k, o in options.items())), lambda x: x.isNotNull())
    return rows.select("game_ord", F.explode(passed).alias("filter"))


@query(
    FLAGGED + TALKED + """, rx AS (SELECT game_ord, bool_or(regexp_matches(name, '-2\\.rom$')) AS hit FROM roms GROUP BY 1)
  SELECT parent_key, game_ord FROM (SELECT t.parent_key, t.game_ord, row_number() OVER (PARTITION BY t.parent_key ORDER BY NOT regexp_matches(t.name, 'blue'), NOT rx.hit, revision, t.game_ord) AS n FROM talked t JOIN rx USING (game_ord)) WHERE n = 1""",
    (GAMES, ROMS),
)
def prefer_regex(spark: SparkSession, d: str) -> DataFrame:
    lists = K.roms(spark, d).groupBy("game_ord").agg(F.collect_set("name").alias("rom_names"))
    rows = named(spark, d).join(lists, "game_ord")
    return G.prefer(rows, Options(input=("in",), single=True, prefer_game_regex="blue", prefer_rom_regex=r"-2\.rom$", prefer_revision="older")).select("parent_key", "game_ord")


# Candidates


@query(BEST + " SELECT game_ord, rom_ord FROM roms WHERE game_ord % 5 = 0 AND (game_ord, rom_ord) NOT IN (SELECT (game_ord, rom_ord) FROM best)", (GAMES, ROMS, FILES))
def empty_roms(spark: SparkSession, d: str) -> DataFrame:
    roms = K.roms(spark, d).withColumn("size", F.when(F.col("game_ord") % 5 == 0, 0).otherwise(F.col("size")))
    return empty_files(roms, best(spark, d), ["game_ord", "rom_ord"])


_DISC_ENTRIES = """, _r3 AS (SELECT game_ord, rom_ord % 2 AS disc, rom_hash, CASE WHEN rom_ord = 0 THEN 'a.CUE' ELSE name END AS name FROM roms),
  holders AS (SELECT archive, sha1 AS rom_hash, bool_or(contains(archive, '/1')) AS image FROM files GROUP BY 1, 2)"""


@query(
    _DISC_ENTRIES + """, sizes AS (SELECT game_ord, disc, count(*) AS n, count(*) FILTER (name <> 'a.CUE') AS tracks FROM _r3 GROUP BY 1, 2),
  found AS (SELECT game_ord, disc, archive, count(*) AS k, count(*) FILTER (name <> 'a.CUE') AS kt, bool_or(image) AS image FROM _r3 JOIN holders USING (rom_hash) GROUP BY 1, 2, 3)
  SELECT game_ord, disc, archive FROM found JOIN sizes USING (game_ord, disc) WHERE k = n OR (image AND kt = tracks AND tracks > 0)""",
    (ROMS, FILES),
)
def division_by_disc(spark: SparkSession, d: str) -> DataFrame:
    roms = K.roms(spark, d).select("game_ord", (F.col("rom_ord") % 2).alias("disc"), "rom_ord", "rom_hash", F.when(F.col("rom_ord") == 0, "a.CUE").otherwise(F.col("name")).alias("name"))
    entries = K.files(spark, d).select("archive", F.col("sha1").alias("rom_hash"), F.when(F.contains("archive", F.lit("/1")), "chd").otherwise("zip").alias("container"))
    return C.divisions(roms, roms.join(entries, "rom_hash"), ["game_ord", "disc"], cue_may_lack=True)


@query(
    DIVIDED + """, facts AS (SELECT archive, bool_or(in_output) AS o FROM files GROUP BY 1), sized AS (SELECT archive, count(*) AS n FROM entries GROUP BY 1),
  chosen AS (SELECT game_ord, archive FROM (SELECT d.game_ord, d.archive, row_number() OVER (PARTITION BY d.game_ord ORDER BY o, n, NOT contains(d.archive, g.name), d.archive) AS i
    FROM divided d JOIN facts USING (archive) JOIN sized USING (archive) JOIN games g USING (game_ord)) WHERE i = 1),
  every AS (SELECT r.game_ord, r.rom_ord, f.path, f.archive, row_number() OVER (PARTITION BY r.game_ord, r.rom_ord ORDER BY c.archive IS DISTINCT FROM f.archive, CASE f.container WHEN 'file' THEN 0 WHEN 'zip' THEN 1 ELSE 4 END, f.in_output, f.path) AS i
    FROM roms r JOIN files f ON r.rom_hash = f.sha1 LEFT JOIN chosen c USING (game_ord))
  SELECT game_ord, rom_ord, path FROM every WHERE i = 1""",
    (GAMES, ROMS, FILES),
)
def choose_inputs(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    chosen = C.best_archive(K.games(spark, d), C.archives_with_every_rom(K.roms(spark, d), entries), entries)
    return C.choose_inputs(M.match(K.roms(spark, d), _keys(spark, d), ["game_ord", "rom_ord"], _order()), chosen).select("game_ord", "rom_ord", "path")


_PADDED = "array<struct<padded_size:bigint,fill_byte:int,crc32:string,md5:string,sha1:string,sha256:string>>"
_PAIRS = """WITH pairs AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 <> 0 THEN 'in/' || p_partkey END AS path, p_partkey % 3 = 0 AS headed, p_partkey % 4 = 0 AS padded, p_size::BIGINT AS size,
  'r' || p_partkey AS raw, 'w' || p_partkey AS wo, ['r', 'w', 'p0-', 'p1-', 'x'][(p_partkey % 5 + 1)::INT] || p_partkey AS rom, p_partkey % 2 = 1 AS removes FROM part)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Roms with their inputs: raw, headerless or padded bytes wanted, or other ones."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    pad = lambda i: F.struct((F.col("p_size").cast("long") * 2 + i).alias("padded_size"), F.lit(0).alias("fill_byte"), none.alias("crc32"), F.concat(F.lit(f"p{i}-"), k).alias("md5"), none.alias("sha1"), none.alias("sha256"))
    nothing = {f"{a}{x}{b}": none for x in ("crc32", "sha1", "sha256") for a, b in (("rom_", ""), ("", ""), ("", "_wo"))}
    return _table(spark, d, "part").select(
        k.alias("k"), F.when(k % 13 != 0, F.concat(F.lit("in/"), k)).alias("path"), F.when(k % 3 == 0, "H").alias("header"), F.when(k % 4 == 0, F.array(pad(0), pad(1))).otherwise(F.array().cast(_PADDED)).cast(_PADDED).alias("paddings"),
        F.col("p_size").cast("long").alias("size"), F.col("p_size").cast("long").alias("size_wo"), F.concat(F.lit("r"), k).alias("md5"), F.concat(F.lit("w"), k).alias("md5_wo"), F.concat(_of(["r", "w", "p0-", "p1-", "x"], k), k).alias("rom_md5"), F.when(k % 2 == 1, ".nes").otherwise(".smc").alias("extension"), *(v.alias(c) for c, v in nothing.items()),
    )


@query(
    _PAIRS + """ SELECT k, headed AND NOT (rom = raw AND NOT removes) AS keeps_header, padded AND rom IN ('p0-' || k, 'p1-' || k) AS keeps_padding, path IS NULL OR (headed AND rom <> raw) AS missing FROM pairs"""
)
def header_choice(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(_pairs(spark, d), writing=True, linking=True, add_padding=True, remove_headers=[".nes"]).select("k", "keeps_header", "keeps_padding", "missing")


@query(
    _PAIRS + """ SELECT k, CASE WHEN padded AND k % 5 = 2 THEN size * 2 ELSE size END AS out_size, CASE WHEN padded AND k % 5 = 2 THEN 'p0-' || k WHEN headed AND rom <> raw THEN wo ELSE raw END AS out_md5, CASE WHEN k % 7 = 0 THEN 'file' ELSE 'entry' END AS out_kind FROM pairs"""
)
def output_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d)
    # what is left once the wanted form is chosen: the header if it goes, and the one padding that is wanted
    rows = rows.withColumn("header", F.when(F.col("rom_md5") != F.col("md5"), F.col("header"))).withColumn("paddings", F.filter("paddings", lambda p: (p["md5"] == F.col("rom_md5")) & (F.col("k") % 5 == 2)))
    rows = rows.withColumns({"whole": F.col("k") % 7 == 0, "container": F.lit("zip"), "entry": F.lit("e")})
    return C.output_digests(rows, writing=True, zipping=True).select("k", "out_size", "out_md5", "out_kind")


_RAW = """, raw AS (SELECT game_ord AS g, rom_ord, name, CASE WHEN game_ord % 31 <> 0 THEN name END AS entry, game_ord % 17 = 0 AS headed, game_ord % 19 = 0 AS padded, CASE WHEN game_ord % 5 = 0 THEN '7z' ELSE 'zip' END AS container,
  CASE WHEN game_ord % 7 = 0 THEN game_ord * 10 + rom_ord ELSE game_ord END AS archive, CASE WHEN game_ord % 11 = 0 THEN 'other' ELSE name END AS wanted, [NULL, 'torrentzip', 'rvzstd', 'torrentzip'][(game_ord % 4 + 1)::INT] AS zk, game_ord % 6 = 0 AS merged FROM roms),
  facts AS (SELECT g, bool_or(entry IS NULL) AS not_entry, bool_or(headed) AS headed, bool_or(padded) AS padded, bool_or(container <> 'zip') AS other, bool_or(coalesce(wanted <> entry, false)) AS differs, count(DISTINCT archive) <> 1 AS several, bool_or(merged) AND count(*) > 1 AS free, bool_or(zk IS NULL) AS unstructured, bool_or(coalesce(zk <> 'torrentzip', false)) AS rv FROM raw GROUP BY g),
  reasons AS (SELECT 'raw' AS mode, g, CASE WHEN not_entry THEN 'not_entry' WHEN headed THEN 'header_differs' WHEN padded THEN 'padding_wanted' WHEN differs THEN 'entry_path_differs' WHEN free THEN NULL WHEN several THEN 'several_archives' END AS reason FROM facts
    UNION ALL SELECT 'zip', g, CASE WHEN not_entry THEN 'not_entry' WHEN headed THEN 'header_differs' WHEN padded THEN 'padding_wanted' WHEN other THEN 'zip_from_other' WHEN differs THEN 'entry_path_differs' WHEN free THEN NULL WHEN several THEN 'several_archives' WHEN unstructured THEN 'zip_unstructured' WHEN rv THEN 'zip_not_torrentzip' END FROM facts)"""


def _raw_rows(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("game_ord"), F.lit(None).cast("string")
    pads = F.array(F.struct(F.lit(1).cast("long").alias("padded_size"), F.lit(0).alias("fill_byte"), none.alias("crc32"), F.col("sha1").alias("md5"), F.col("rom_hash").alias("sha1"), none.alias("sha256")))
    rows = K.roms(spark, d).withColumns(
        {
            "entry": F.when(k % 31 != 0, F.col("name")), "header": F.when(k % 17 == 0, "H"), "md5_wo": F.when(k % 17 == 0, "x"), "paddings": F.when(k % 19 == 0, pads).otherwise(F.array().cast(_PADDED)).cast(_PADDED), "container": F.when(k % 5 == 0, "7z").otherwise("zip"),
            "archive": F.when(k % 7 == 0, k * 10 + F.col("rom_ord")).otherwise(k).cast("string"), "wanted_entry": F.when(k % 11 == 0, "other").otherwise(F.col("name")), "zip_kind": F.when(k % 4 == 0, none).when(k % 4 == 2, "rvzstd").otherwise("torrentzip"), "merged_disc": k % 6 == 0, "out_path": F.col("name"),
            "rom_md5": F.col("md5"), "rom_sha1": F.col("rom_hash"), "rom_crc32": none, "rom_sha256": none, "crc32_wo": none, "sha1_wo": none, "sha256_wo": none, "is_disk": (k % 23 == 0),
        }
    )
    return rows


@query(_RAW + " SELECT mode, g AS game_ord, reason FROM reasons", (ROMS,))
def raw_archives(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw_rows(spark, d)
    return C.raw_facts(rows).withColumn("mode", F.lit("raw")).unionByName(C.raw_facts(rows, zipping=True).withColumn("mode", F.lit("zip")))


@query(_RAW + " SELECT raw.g AS game_ord, rom_ord, entry IS NOT NULL AND (reason IS NULL OR raw.g % 23 = 0) AS whole FROM raw JOIN reasons ON raw.g = reasons.g AND mode = 'raw' WHERE entry IS NULL OR reason IS NULL OR raw.g % 23 = 0", (ROMS,))
def whole_archives(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw_rows(spark, d)
    return C.as_archives(rows, C.raw_facts(rows), writing=True, extracting=False, zipping=False).select("game_ord", "rom_ord", "whole")


_CUES = ", _c AS (SELECT game_ord, rom_ord, CASE WHEN rom_ord = 0 THEN 'd.cue' WHEN game_ord % 4 = 3 THEN 'd.txt' ELSE rom_ord || '.BIN' END AS name FROM roms)"


@query(BEST + _CUES + ", _f AS (SELECT game_ord, rom_ord FROM best WHERE rom_ord > 0) SELECT game_ord FROM _c LEFT JOIN _f USING (game_ord, rom_ord) GROUP BY 1 HAVING bool_or(name = 'd.cue') AND bool_or(name LIKE '%.BIN') AND bool_and(name = 'd.cue' OR name LIKE '%.BIN') AND bool_and(_f.rom_ord IS NOT NULL OR name = 'd.cue')", (GAMES, ROMS, FILES))
def cues_missing(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("game_ord"), F.col("rom_ord")
    roms = K.roms(spark, d).select("game_ord", "rom_ord", F.when(i == 0, "d.cue").when(k % 4 == 3, "d.txt").otherwise(F.concat(i, F.lit(".BIN"))).alias("name"))
    return C.only_cues_missing(roms, roms.join(best(spark, d).where("rom_ord > 0"), ["game_ord", "rom_ord"], "left_semi"))


_SHOWN = ["a.rom", "B.ROM", "plain", "PLAIN", "c.tar.gz", "sub/d"]


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN name WHEN name IN ('plain', 'PLAIN', 'sub/d') THEN name || ext ELSE name END AS fixed, CASE WHEN p_partkey % 4 = 0 THEN name WHEN name = 'B.ROM' THEN 'B' || upper(ext) WHEN contains(name, '.') THEN regexp_replace(name, '\\.[a-zA-Z0-9]+$', '') || ext ELSE name || ext END AS always FROM (SELECT p_partkey, "
    + _sql_of(_SHOWN, "p_partkey") + " AS name, " + _sql_of([".nes", ".gb", ".z64"], "p_partkey") + " AS ext FROM part)"
)
def extension_fix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name, ext = _of(_SHOWN, k), F.when(k % 4 != 0, _of([".nes", ".gb", ".z64"], k))
    return _table(spark, d, "part").select("p_partkey", R.with_extension(name, ext).alias("fixed"), R.with_extension(name, ext, "always").alias("always"))


_ZIPPED = """, _o AS (SELECT g.game_ord // 16 AS dat_id, b.game_ord, b.rom_ord, g.name, b.path, 'r' || (b.game_ord * 3 + b.rom_ord) % 40 || '.rom' AS entry FROM best b JOIN games g USING (game_ord)),
  _z AS (SELECT *, row_number() OVER (PARTITION BY dat_id, entry ORDER BY game_ord, rom_ord) AS i FROM _o), _y AS (SELECT *, count(*) OVER (PARTITION BY dat_id, game_ord) AS n FROM _z WHERE i = 1)"""


@query(BEST + _ZIPPED + " SELECT dat_id, game_ord, path, CASE WHEN n > 1 THEN name || '/' || entry ELSE entry END AS entry FROM _y", (GAMES, ROMS, FILES))
def combined_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = best(spark, d).join(K.games(spark, d).select("game_ord", "name"), "game_ord")
    k, i = F.col("game_ord"), F.col("rom_ord")
    return C.combined(rows.withColumns({"dat_id": F.floor(k / 16), "entry": F.concat(F.lit("r"), (k * 3 + i) % 40, F.lit(".rom"))})).select("dat_id", "game_ord", "path", "entry")


@query(BEST + " SELECT DISTINCT 'out/' || upper(name[1]) || '/' || b.game_ord % 3 AS dir FROM best b JOIN games USING (game_ord)", (GAMES, ROMS, FILES))
def output_dirs(spark: SparkSession, d: str) -> DataFrame:
    rows = best(spark, d).join(K.games(spark, d).select("game_ord", "name"), "game_ord")
    return C.output_dirs(rows.select(F.concat_ws("/", F.lit("out"), F.upper(F.substring("name", 1, 1)), F.col("game_ord") % 3, F.col("rom_ord")).alias("out_path")))


@query(BEST + " SELECT game_ord, row_number() OVER (ORDER BY n_roms, name, game_ord) AS place FROM statuses WHERE status <> 'MISSING'", (GAMES, ROMS, FILES))
def write_order(spark: SparkSession, d: str) -> DataFrame:
    rows = statuses(spark, d).where("status <> 'MISSING'")
    return C.placed(rows.select("game_ord", "n_roms", "name"), [*C.write_order(rows), F.col("game_ord")]).select("game_ord", "place")


@query(" SELECT r.game_ord // 10 AS dat_id, count(*) AS n_roms, sum(size)::BIGINT AS n_bytes FROM roms r GROUP BY 1", (ROMS,))
def size_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.size_totals(K.roms(spark, d).withColumn("dat_id", F.floor(F.col("game_ord") / 10)), ["dat_id"])


@query(" SELECT archive AS path, count(*) AS n_entries, sum(size)::BIGINT AS n_bytes FROM files GROUP BY 1", (FILES,))
def files_by_path(spark: SparkSession, d: str) -> DataFrame:
    return R.files_by_path(K.files(spark, d).select(F.col("archive").alias("path"), "size"))


_WANTED = "CASE WHEN size % 3 = 0 THEN 'other' WHEN size % 3 = 1 THEN entry END"


@query(f" SELECT DISTINCT 'raw' AS mode, path, entry FROM files WHERE NOT coalesce(container <> 'file' AND ({_WANTED}) <> entry, false) UNION ALL SELECT DISTINCT 'read', path, entry FROM files WHERE container <> '7z' OR kind = 1", (FILES,))
def legal_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = K.files(spark, d).withColumns({"wanted_entry": F.when(F.col("size") % 3 == 0, "other").when(F.col("size") % 3 == 1, F.col("entry")), "is_disk": F.col("kind") == 1})
    rows = rows.withColumn("container", F.when(F.col("container") == "file", "gzip").otherwise(F.col("container")))
    one = lambda mode, raw: C.legal_inputs(rows, raw).select(F.lit(mode).alias("mode"), "path", "entry").distinct()
    return one("raw", True).union(one("read", False))


@query(BEST + " SELECT game_ord, rom_ord FROM (SELECT b.game_ord, b.rom_ord, bool_and(NOT starts_with(b.path, 'out/')) OVER (PARTITION BY b.game_ord) AS ok FROM best b) WHERE ok", (GAMES, ROMS, FILES))
def writable(spark: SparkSession, d: str) -> DataFrame:
    return C.writable(best(spark, d).withColumn("can_be_input", ~F.col("path").startswith("out/"))).select("game_ord", "rom_ord")


@query(BEST + " SELECT b.game_ord, b.rom_ord, CASE WHEN b.archive IN (SELECT archive FROM _arch) THEN length(b.archive) END AS archive_size FROM best b".replace(" SELECT b.game_ord", ", _arch AS (SELECT DISTINCT archive FROM files WHERE in_output) SELECT b.game_ord"), (GAMES, ROMS, FILES))
def archive_hashes(spark: SparkSession, d: str) -> DataFrame:
    files = K.files(spark, d).where("in_output").select(F.col("archive").alias("path"), F.length("archive").cast("long").alias("size"), F.lit("00000000").alias("crc32"))
    return C.with_archive_hashes(best(spark, d), files, True).select("game_ord", "rom_ord", "archive_size")


@query(
    BEST + """, cands AS (SELECT game_ord AS candidate, 'h' || game_ord % 700 AS h, name, manufacturer AS des FROM games WHERE game_ord % 3 <> 1),
  strong AS (SELECT h, min(candidate) AS s FROM cands GROUP BY 1), weak AS (SELECT name, des, min(candidate) AS w FROM cands GROUP BY 1, 2)
  SELECT g.game_ord, coalesce(s, w) AS candidate FROM games g LEFT JOIN strong ON h = 'h' || (CASE WHEN g.game_ord % 2 = 0 THEN g.game_ord ELSE g.game_ord + 350 END) % 700 LEFT JOIN weak ON weak.name = g.name AND weak.des = g.manufacturer""",
    (GAMES, ROMS, FILES),
)
def candidate_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("game_ord")
    games = K.games(spark, d).select("game_ord", "name", F.col("manufacturer").alias("description"))
    candidates = games.where(k % 3 != 1).select(k.alias("candidate"), F.concat(F.lit("h"), k % 700).alias("game_hash"), "name", "description")
    return C.candidates_of(games.withColumn("game_hash", F.concat(F.lit("h"), F.when(k % 2 == 0, k).otherwise(k + 350) % 700)), candidates).select("game_ord", "candidate")


# Sets


@query(" SELECT game_ord // 4 AS dat_id FROM games GROUP BY 1 HAVING count(*) <> count(DISTINCT parent_key)", (GAMES,))
def merge_guard(spark: SparkSession, d: str) -> DataFrame:
    games = K.games(spark, d).withColumn("dat_id", F.floor(F.col("game_ord") / 4))
    return S.may_merge(games, "split", ["dat_id"]).union(S.may_merge(games, None, ["dat_id"]))


_BIOS = """, _k AS (SELECT p_partkey AS game_ord, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 50 = 7 THEN -1 ELSE p_partkey - p_partkey % 50 END AS rom_of, p_partkey % 100 = 0 AS is_bios FROM part),
  _b AS (SELECT r.game_ord, rom_ord, 's' || rom_ord AS name, CASE WHEN r.game_ord % 4 = 1 THEN rom_hash ELSE 'same' || rom_ord END AS h, CASE WHEN rom_ord = 0 THEN 'yes' END AS bios FROM roms r)"""


@query(
    _BIOS + """ SELECT a.game_ord, a.rom_ord FROM _b a JOIN _k USING (game_ord) WHERE NOT EXISTS (SELECT 1 FROM _b o JOIN _k k ON o.game_ord = k.game_ord WHERE k.game_ord = _k.rom_of AND (k.is_bios OR o.bios IS NOT NULL) AND o.name = a.name AND o.h = a.h)""",
    (ROMS,),
)
def without_bios(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    games = _table(spark, d, "part").select(k.alias("game_ord"), F.when(k % 50 == 0, None).when(k % 50 == 7, -1).otherwise(k - k % 50).cast("long").alias("rom_of"), (k % 100 == 0).alias("is_bios"))
    roms = K.roms(spark, d).select("game_ord", "rom_ord", F.concat(F.lit("s"), "rom_ord").alias("name"), F.when(F.col("game_ord") % 4 == 1, F.col("rom_hash")).otherwise(F.concat(F.lit("same"), "rom_ord")).alias("rom_hash"), F.when(F.col("rom_ord") == 0, "yes").alias("bios"))
    return S.without_bios_roms(games, roms).select("game_ord", "rom_ord")


@query(
    """, _d AS (SELECT r.game_ord, rom_ord, 'd' || r.game_ord % 5 AS name, rom_hash, parent_key, clone_of FROM roms r JOIN games USING (game_ord)), _p AS (SELECT parent_key, game_ord AS parent_ord FROM games WHERE clone_of IS NULL),
  _x AS (SELECT parent_ord, name, rom_hash, row_number() OVER (PARTITION BY parent_ord, name ORDER BY _d.game_ord = parent_ord, _d.game_ord, rom_ord) AS n FROM _d JOIN _p USING (parent_key)) SELECT parent_ord AS game_ord, name, rom_hash FROM _x WHERE n = 1""",
    (GAMES, ROMS),
)
def merged_disks(spark: SparkSession, d: str) -> DataFrame:
    return S.merged_disks(K.games(spark, d), K.roms(spark, d).withColumn("name", F.concat(F.lit("d"), F.col("game_ord") % 5)))


@query(BEST + " SELECT DISTINCT path FROM files f JOIN (SELECT DISTINCT sha1, container FROM files JOIN best USING (path, container)) USING (sha1, container)".replace(" USING (path, container)", " b USING (path)").replace("SELECT DISTINCT sha1, container FROM files JOIN best b", "SELECT DISTINCT o.sha1, o.container FROM files o JOIN best b"), (GAMES, ROMS, FILES))
def moved_inputs(spark: SparkSession, d: str) -> DataFrame:
    files = K.files(spark, d).select("path", F.col("sha1").alias("file_hash"), "container")
    return R.moved_inputs(files.join(best(spark, d).select("path"), "path", "left_semi"), files, rewritten=True)


# Inference and summaries


@query(" SELECT path, dat FROM (SELECT DISTINCT path FROM files), (SELECT unnest(['in', 'out', 'in/1', 'in/2']) AS dat) WHERE starts_with(path, dat || '/')", (FILES,))
def infer_by_input(spark: SparkSession, d: str) -> DataFrame:
    return I.by_input(K.files(spark, d).select("path").distinct(), ["in", "out/", "in/1", "in/2"])


@query(
    """WITH k AS (SELECT p_partkey AS k FROM part),
  raws AS (SELECT 'r/' || k // 6 || '/' || k || '.rom' AS path, 'r/' || k // 6 AS dir, k FROM k WHERE k % 4 = 3)
  SELECT k::VARCHAR AS game, 'e.rom' AS rom, 'z/' || k || '.zip' AS path FROM k WHERE k % 4 = 2
  UNION ALL SELECT k::VARCHAR, x, 's/' || x FROM (SELECT k, unnest([k || '.cue', k || '-1.bin', k || '-2.bin']) AS x FROM k WHERE k % 4 = 0 AND k % 8 <> 0)
  UNION ALL SELECT CASE WHEN x LIKE '%.cue' THEN k::VARCHAR ELSE k || '-1' END, x, 's/' || x FROM (SELECT k, unnest([k || '.cue', k || '-1.bin']) AS x FROM k WHERE k % 8 = 0)
  UNION ALL SELECT k::VARCHAR, x, 's/' || x FROM (SELECT k, unnest([k || '.gdi', k || ' track.raw', k || '.bin']) AS x FROM k WHERE k % 4 = 1 AND k % 3 <> 0)
  UNION ALL SELECT CASE WHEN x LIKE '%.gdi' THEN k::VARCHAR ELSE k || ' track' END, x, 's/' || x FROM (SELECT k, unnest([k || '.gdi', k || ' track.raw']) AS x FROM k WHERE k % 4 = 1 AND k % 3 = 0)
  UNION ALL SELECT CASE WHEN count(*) OVER (PARTITION BY dir) > 1 THEN (k // 6)::VARCHAR ELSE k::VARCHAR END, k || '.rom', path FROM raws"""
)
def infer_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Archives, cue sheets, gdi sheets and plain files, each kind taking its files away; some sheets name a file that is not there."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    at = lambda *parts: F.concat(F.lit("s/"), *(k if x is None else F.lit(x) for x in parts))
    row = lambda path, entry=none, container="file": F.struct(path.alias("path"), entry.alias("entry"), F.lit(container).alias("container"))
    found = (
        F.when(k % 8 == 0, F.array(row(at(None, ".cue")), row(at(None, "-1.bin"))))
        .when(k % 4 == 0, F.array(row(at(None, ".cue")), row(at(None, "-1.bin")), row(at(None, "-2.bin"))))
        .when((k % 4 == 1) & (k % 3 == 0), F.array(row(at(None, ".gdi")), row(at(None, " track.raw"))))
        .when(k % 4 == 1, F.array(row(at(None, ".gdi")), row(at(None, " track.raw")), row(at(None, ".bin"))))
        .when(k % 4 == 2, F.array(row(F.concat(F.lit("z/"), k, F.lit(".zip")), F.lit("e.rom"), "zip")))
        .otherwise(F.array(row(F.concat(F.lit("r/"), F.floor(k / 6), F.lit("/"), k, F.lit(".rom")))))
    )
    parts = _table(spark, d, "part")
    files = parts.select(F.explode(found).alias("f")).select("f.*")
    cue = F.concat(F.lit('FILE "'), k, F.lit('-1.bin" BINARY\r\n  TRACK 01 MODE1/2352\r\nFILE '), k, F.lit("-2.bin BINARY\r\n"))
    gdi = F.concat(F.lit('2\n1 0 4 2352 "'), k, F.lit(' track.raw" 0\n2 450 0 2352 '), k, F.lit(".bin 0\n"))
    sheets = parts.where(k % 4 == 0).select(at(None, ".cue").alias("path"), cue.alias("content")).union(parts.where(k % 4 == 1).select(at(None, ".gdi"), gdi))
    return I.cascade(files, sheets)


@query(
    BEST + FLAGGED + """, z AS (SELECT f.*, s.status FROM flagged f JOIN statuses s USING (game_ord)), kinds AS (SELECT 'games' AS kind, true AS k, status FROM z UNION ALL SELECT 'bioses', is_bios, status FROM z UNION ALL SELECT 'retail', is_retail, status FROM z),
  told AS (SELECT kind, count(*) FILTER (k) AS a, count(*) FILTER (k AND status = 'FOUND') AS f FROM kinds GROUP BY 1)
  SELECT string_agg(format('{:,}', f) || '/' || format('{:,}', a) || ' ' || kind, ', ' ORDER BY kind) AS summary FROM told WHERE a > 0""",
    (GAMES, ROMS, FILES),
)
def console_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary_text(R.status_summary(G.with_names(statuses(spark, d)), R.allowed_kinds(frozenset(), frozenset({"device"}), False)))


@query(BEST + " SELECT game_ord, CASE WHEN n_found = n_roms THEN 100 WHEN n_found * 4 >= n_roms * 3 THEN 75 WHEN n_found * 2 >= n_roms THEN 50 WHEN n_found > 0 THEN 25 ELSE 0 END AS band FROM statuses", (GAMES, ROMS, FILES))
def percent_bands(spark: SparkSession, d: str) -> DataFrame:
    return statuses(spark, d).select("game_ord", R.percent_band(F.col("n_found"), F.col("n_roms")).alias("band"))


# Paths

_CONSOLES = [("small", [".rom"], {"sys": "A"}), ("ring$", [".zip"], {"sys": "B$1"}), ("widget", [".rom", ".bin"], {"sys": "C"}), ("none", [".7z"], {"sys": "D"})]


@query(
    "SELECT p_partkey, coalesce(CASE WHEN regexp_matches(p_name, 'none') THEN 'D' WHEN regexp_matches(p_name, 'widget') THEN 'C' WHEN regexp_matches(p_name, 'ring$') THEN 'B$1' WHEN regexp_matches(p_name, 'small') THEN 'A' WHEN ext = '.7z' THEN 'D' WHEN ext IN ('.ROM', '.bin') THEN 'C' WHEN ext = '.zip' THEN 'B$1' END, '{sys}') || '/x' AS path FROM (SELECT *, "
    + _sql_of([".ROM", ".zip", ".7z", ".bin", ".txt"], "p_partkey") + " AS ext FROM part)"
)
def console_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "part").select("p_partkey", "p_name", _of([".ROM", ".zip", ".7z", ".bin", ".txt"], F.col("p_partkey")).alias("ext"), F.lit("{sys}/x").alias("path"))
    return P.console_tokens(rows, "path", _CONSOLES, "p_name", "ext").select("p_partkey", "path")


@query(
    r""", f AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM files)
  SELECT path, 'o/' || dir || '/' || regexp_replace(base, '^(.+)\.[^.]*$', '\1') || '-' || regexp_extract(base, '\.([^.]*)$', 1) || '/' || base || CASE WHEN starts_with(path, 'in/') THEN '' ELSE '{region}' END AS told, NOT starts_with(path, 'in/') AS leftover, regexp_replace(dir, '^(in|out)/', '') AS mirrored FROM f""",
    (FILES,),
)
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = K.files(spark, d).select("path").distinct().withColumns({"region": F.when(F.col("path").startswith("in/"), F.lit(" ")), **{c: none for c in ("language", "game_type", "genre", "category", "dat_name", "dat_description")}})
    tokens = P.game_tokens(F.col("path"), F.col("path"))
    told = F.rtrim(P.replace_tokens(F.lit("o/{inputDirname}/{outputName}-{outputExt}/{outputBasename}{region}"), tokens))
    return rows.select("path", told.alias("told"), P.has_leftover(told).alias("leftover"), P.mirror(F.col("path"), ["in", "out/"]).alias("mirrored"))


_INS = ["in/a.zip", "in/b.tar.gz", "in/c.rom", "in/d.nkit.iso"]


@query(
    "WITH g AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN p_name || '.tar' ELSE p_name END AS game, " + _sql_of(["a.rom", "sub/b.bin", "c"], "p_partkey") + " AS rom, " + _sql_of([".zip", ".tar.gz", ".rom", ".nkit.iso"], "p_partkey")
    + """ AS ext, p_partkey % 4 = 0 AS zipped, p_partkey % 4 = 1 AS kept, p_partkey % 5 > 1 AS several, p_partkey % 12 = 7 AS merged, p_partkey % 11 = 0 AS disk, p_partkey % 7 = 0 AS headed FROM part),
  b AS (SELECT *, CASE WHEN zipped THEN game || '.zip' WHEN kept AND k % 9 = 0 AND ext = '.tar.gz' THEN p.game_short || ext WHEN kept THEN game || ext ELSE rom END AS base FROM g JOIN (SELECT p_partkey, p_name AS game_short FROM part) p ON p.p_partkey = g.k)
  SELECT k, base, CASE WHEN disk THEN regexp_replace(rom, '(?i)\\.chd$', '') || '.chd' WHEN headed AND rom <> 'c' THEN regexp_replace(rom, '\\.[^/.]*$', '') || '.sfc' ELSE rom END AS rom_name,
    CASE WHEN merged OR (several AND NOT (zipped OR kept)) THEN game || '/' || base ELSE base END AS multiple, CASE WHEN merged THEN game || '/' || base ELSE base END AS never, game || '/' || base AS always FROM b"""
)
def game_dirs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    game, rom = F.when(k % 9 == 0, F.concat("p_name", F.lit(".tar"))).otherwise(F.col("p_name")), _of(["a.rom", "sub/b.bin", "c"], k)
    zipped, kept, merged = k % 4 == 0, k % 4 == 1, k % 12 == 7
    base = P.output_basename(game, rom, _of(["in/a.zip", "in/b.tar.gz", "in/c.rom", "in/d.nkit.iso"], k), zipped, kept)
    placed = lambda mode: P.in_game_dir(base, game, rom, mode, k % 5 > 1, zipped | kept, merged).alias(mode)
    return _table(spark, d, "part").select(k.alias("k"), base.alias("base"), P.rom_basename(rom, k % 11 == 0, F.when(k % 7 == 0, ".sfc")).alias("rom_name"), *map(placed, ("multiple", "never", "always")))


# The whole reconciliation

#: Games of names that no other has; roms of which clones of an even number share the first with their parent; files outside of archives without an entry.
_CATALOG = """, gx AS (SELECT * EXCLUDE (name, clone_of), name || ' #' || game_ord AS name, CASE WHEN clone_of IS NOT NULL THEN clone_of || ' #' || min(game_ord) OVER (PARTITION BY parent_key) END AS clone_of FROM games),
  rx AS (SELECT r.game_ord, rom_ord, CASE WHEN r.game_ord % 2 = 0 AND rom_ord = 0 THEN 'shared.rom' ELSE name END AS name, size, sha1, md5, sha256, CASE WHEN r.game_ord % 2 = 0 AND rom_ord = 0 THEN parent_key ELSE rom_hash END AS rom_hash, coalesce(sha256, sha1, md5) AS strongest, parent_key, clone_of
    FROM (SELECT r.*, g.parent_key, g.clone_of FROM roms r JOIN gx g USING (game_ord) WHERE status <> 'nodump') r),
  fx AS (SELECT path, CASE WHEN container = 'file' THEN path ELSE archive END AS archive, CASE WHEN container <> 'file' THEN entry END AS entry, container, in_output, sha1, md5, sha256 FROM files)"""


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    games = K.games(spark, d).drop("rom_of")
    first = games.groupBy("parent_key").agg(F.min("game_ord").alias("_first"))
    games = games.join(first, "parent_key").withColumns({"name": F.concat("name", F.lit(" #"), "game_ord"), "clone_of": F.when(F.col("clone_of").isNotNull(), F.concat("clone_of", F.lit(" #"), "_first"))}).drop("_first")
    alike = (F.col("game_ord") % 2 == 0) & (F.col("rom_ord") == 0)
    roms = K.roms(spark, d).join(games.select("game_ord", "parent_key"), "game_ord")
    roms = roms.withColumns({"name": F.when(alike, "shared.rom").otherwise(F.col("name")), "rom_hash": F.when(alike, F.col("parent_key")).otherwise(F.col("rom_hash"))}).drop("parent_key")
    # repeated rows change nothing in a reconciliation, and need not be told apart
    return games, roms, K.files(spark, d, once=False).withColumns({"entry": F.when(F.col("container") != "file", F.col("entry")), "archive": F.when(F.col("container") == "file", F.col("path")).otherwise(F.col("archive"))})


def _inputs(roms: str, games: str, legal: str) -> str:
    """SQL views: the input of every rom of ``roms``, and the statuses of ``games``."""
    return f""", m AS (SELECT r.game_ord, r.rom_ord, f.path, f.archive, f.entry, row_number() OVER (PARTITION BY r.game_ord, r.rom_ord ORDER BY CASE f.container WHEN 'file' THEN 0 WHEN 'zip' THEN 1 ELSE 4 END, f.path) AS place
    FROM {roms} r JOIN fx f ON r.strongest = CASE WHEN r.sha256 IS NOT NULL THEN f.sha256 WHEN r.sha1 IS NOT NULL THEN f.sha1 ELSE f.md5 END WHERE {legal}),
  n AS (SELECT game_ord, count(*) AS n_roms FROM {roms} GROUP BY 1),
  whole AS (SELECT game_ord, archive FROM (SELECT game_ord, archive, count(DISTINCT rom_ord) AS k FROM m WHERE entry IS NOT NULL GROUP BY 1, 2) JOIN n USING (game_ord) WHERE k = n_roms),
  about AS (SELECT archive, bool_or(in_output) AS o, count(*) AS k FROM (SELECT DISTINCT archive, entry, container, in_output, sha256 FROM fx WHERE entry IS NOT NULL) GROUP BY 1),
  chosen AS (SELECT game_ord, archive FROM (SELECT w.game_ord, w.archive, row_number() OVER (PARTITION BY w.game_ord ORDER BY o, k, NOT contains(w.archive, g.name), w.archive) AS i FROM whole w JOIN about USING (archive) JOIN {games} g USING (game_ord)) WHERE i = 1),
  pick AS (SELECT game_ord, rom_ord, path, archive, entry FROM (SELECT m.*, row_number() OVER (PARTITION BY m.game_ord, m.rom_ord ORDER BY m.entry IS NULL OR c.archive IS DISTINCT FROM m.archive, place) AS i FROM m LEFT JOIN chosen c USING (game_ord)) WHERE i = 1)"""


def _inputs_done(roms: str, games: str, legal: str, pick: str = "pick") -> str:
    return _inputs(roms, games, legal) + f""", k AS (SELECT g.game_ord, coalesce(max(n_roms), 0) AS n_roms, count(p.path) AS n_found FROM {games} g LEFT JOIN n USING (game_ord) LEFT JOIN {pick} p USING (game_ord) GROUP BY 1),
  done AS (SELECT *, CASE WHEN n_found >= n_roms THEN 'FOUND' WHEN n_found > 0 THEN 'INCOMPLETE' ELSE 'MISSING' END AS status FROM k)"""


_READ = "(f.entry IS NULL OR f.container = 'zip')"


@query(
    _CATALOG
    + ", sx AS (SELECT c.* FROM rx c WHERE NOT EXISTS (SELECT 1 FROM rx p WHERE c.clone_of IS NOT NULL AND p.clone_of IS NULL AND p.parent_key = c.parent_key AND p.name = c.name AND p.rom_hash = c.rom_hash))"
    + _inputs_done("sx", "gx", _READ)
    + " SELECT p.game_ord, p.rom_ord, p.path, g.name || '.zip' AS out_path, s.name AS out_entry FROM pick p JOIN gx g USING (game_ord) JOIN sx s USING (game_ord, rom_ord)",
    (GAMES, ROMS, FILES),
)
def reconcile_split_zip(spark: SparkSession, d: str) -> DataFrame:
    done = reconcile(*_catalog(spark, d), Options(commands=frozenset({"copy", "zip"}), merge_roms="split", allow_incomplete_sets=True))
    return done.outputs.select("game_ord", "rom_ord", "path", "out_path", "out_entry")


_MERGED = """, tops AS (SELECT parent_key, game_ord AS top, name AS top_name FROM gx WHERE clone_of IS NULL),
  mx AS (SELECT top AS game_ord, top_name, CASE WHEN g.clone_of IS NULL THEN r.name ELSE g.name || '/' || r.name END AS name, r.rom_hash, r.sha1, r.md5, r.sha256, r.strongest FROM (
      SELECT r.*, row_number() OVER (PARTITION BY t.top, r.rom_hash ORDER BY r.clone_of IS NULL, r.game_ord, r.rom_ord) AS i, t.top, t.top_name FROM rx r JOIN tops t USING (parent_key)) r
    JOIN gx g ON g.game_ord = r.game_ord WHERE i = 1),
  mr AS (SELECT *, row_number() OVER (PARTITION BY game_ord ORDER BY contains(name, '/'), name, rom_hash) - 1 AS rom_ord FROM mx), mg AS (SELECT game_ord, name FROM gx WHERE clone_of IS NULL)"""


@query(
    _CATALOG + _MERGED + _inputs_done("mr", "mg", _READ)
    + """, o AS (SELECT p.game_ord, p.path, CASE WHEN n_roms > 1 THEN top_name || '/' || r.name ELSE r.name END AS file FROM pick p JOIN mr r USING (game_ord, rom_ord) JOIN n USING (game_ord))
  SELECT game_ord, path, 'o/' || regexp_replace(upper(left(file, 1)), '[^A-Z]', '#') || '/' || file AS out_path FROM o""",
    (GAMES, ROMS, FILES),
)
def reconcile_merged(spark: SparkSession, d: str) -> DataFrame:
    options = Options(commands=frozenset({"copy", "extract"}), merge_roms="merged", allow_incomplete_sets=True, output="o", dir_letter=True)
    return reconcile(*_catalog(spark, d), options).outputs.select("game_ord", "path", "out_path")


@query(
    _CATALOG + """, dx AS (SELECT game_ord, row_number() OVER (PARTITION BY game_ord ORDER BY dev DESC, rom_ord) - 1 AS rom_ord, strongest, sha1, md5, sha256 FROM (SELECT *, false AS dev FROM rx UNION ALL SELECT r.* REPLACE (g.game_ord AS game_ord), true FROM gx g JOIN rx r ON r.game_ord = g.game_ord + 1 WHERE g.game_ord % 11 = 0))"""
    + _inputs_done("dx", "gx", _READ) + " SELECT game_ord, n_roms, n_found, CASE WHEN status = 'INCOMPLETE' THEN 'MISSING' ELSE status END AS status FROM done",
    (GAMES, ROMS, FILES),
)
def reconcile_full(spark: SparkSession, d: str) -> DataFrame:
    games, roms, files = _catalog(spark, d)
    return reconcile(games, roms, files, Options(), device_refs=_refs(games)).statuses.select("game_ord", "n_roms", "n_found", "status")


@query(
    _CATALOG + _inputs("rx", "gx", "true") + """, mixed AS (SELECT game_ord FROM pick WHERE entry IS NOT NULL GROUP BY 1 HAVING count(DISTINCT archive) > 1),
  kept AS (SELECT * FROM pick WHERE game_ord NOT IN (SELECT game_ord FROM mixed)), held AS (SELECT DISTINCT game_ord, archive, entry FROM kept WHERE entry IS NOT NULL),
  excess AS (SELECT DISTINCT h.game_ord FROM (SELECT DISTINCT game_ord, archive FROM held) h JOIN (SELECT DISTINCT archive, entry FROM fx WHERE entry IS NOT NULL) f USING (archive) WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.game_ord = h.game_ord AND x.archive = f.archive AND x.entry = f.entry)),
  pure AS (SELECT * FROM kept WHERE game_ord NOT IN (SELECT game_ord FROM excess)),
  k AS (SELECT g.game_ord, coalesce(max(n_roms), 0) AS n_roms, count(p.path) AS n_found FROM gx g LEFT JOIN n USING (game_ord) LEFT JOIN pure p USING (game_ord) GROUP BY 1)
  SELECT game_ord, n_roms, n_found, CASE WHEN n_found >= n_roms THEN 'FOUND' ELSE 'MISSING' END AS status FROM k""",
    (GAMES, ROMS, FILES),
)
def reconcile_raw(spark: SparkSession, d: str) -> DataFrame:
    games, roms, files = _catalog(spark, d)
    entry = F.concat(F.lit("part-"), F.col("game_ord"), F.lit("-"), F.col("rom_ord"), F.lit(".rom"))
    return reconcile(games, roms.withColumn("name", entry), files, Options(commands=frozenset({"move"}))).statuses.select("game_ord", "n_roms", "n_found", "status")


_ONE = Options(commands=frozenset({"copy", "extract"}), input=("in",), single=True, merge_roms="nonmerged", prefer_region=("USA", "EUR"), prefer_verified=True, no=frozenset({"demo", "bios"}), allow_incomplete_sets=True, dir_game_subdir="never", output="o/{region}")


@query(
    _CATALOG + FLAGGED.replace("FROM games)", "FROM (SELECT * EXCLUDE (rom_of) FROM gx))") + TALKED
    + ", ok AS (SELECT * FROM talked WHERE NOT is_demo AND NOT is_bios), one AS (SELECT game_ord, name, regions FROM (SELECT *, row_number() OVER (PARTITION BY parent_key ORDER BY NOT is_verified, coalesce(list_min(list_transform(regions, lambda v: coalesce(list_position(['USA', 'EUR'], v), 3))), 3), game_ord) AS i FROM ok) WHERE i = 1),"
    + " ox AS (SELECT r.* FROM rx r JOIN one USING (game_ord))" + _inputs("ox", "one", _READ)
    + ", spread AS (SELECT game_ord, unnest(list_distinct(regions)) AS region FROM one) SELECT p.game_ord, p.rom_ord, p.path, 'o/' || region || '/part-' || p.game_ord || '-' || p.rom_ord || '.rom' AS out_path FROM pick p JOIN ox r USING (game_ord, rom_ord) JOIN spread USING (game_ord) WHERE region <> ''",
    (GAMES, ROMS, FILES),
)
def reconcile_1g1r(spark: SparkSession, d: str) -> DataFrame:
    games, roms, files = _catalog(spark, d)
    entry = F.concat(F.lit("part-"), F.col("game_ord"), F.lit("-"), F.col("rom_ord"), F.lit(".rom"))
    return reconcile(games, roms.withColumn("name", F.when(F.col("name") == "shared.rom", entry).otherwise(F.col("name"))), files, _ONE).outputs.select("game_ord", "rom_ord", "path", "out_path")


@query(
    _CATALOG + """, sized AS (SELECT game_ord % 3 AS dat_id, row_number() OVER (PARTITION BY game_ord % 3 ORDER BY game_ord) AS rank, game_ord FROM gx)"""
    + _inputs_done("rx", "gx", _READ) + " SELECT dat_id, name, n_roms, n_found FROM done JOIN sized USING (game_ord) JOIN gx USING (game_ord)",
    (GAMES, ROMS, FILES),
)
def reconcile_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Three catalogs whose games are numbered from 0 in each."""
    games, roms, files = _catalog(spark, d)
    dat = (F.col("game_ord") % 3).alias("dat_id")
    local = F.floor(F.col("game_ord") / 3).alias("game_ord")
    games = games.select(dat, local, *[c for c in games.columns if c != "game_ord"])
    done = reconcile(games, roms.select(dat, local, *[c for c in roms.columns if c != "game_ord"]), files, Options(merge_roms="nonmerged"))
    return done.statuses.select("dat_id", "name", "n_roms", "n_found")
