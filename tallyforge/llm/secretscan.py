"""Secret scans over a ledger of blobs: each distinct content is scanned once per rule version."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, materialize, small_batches, table

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"
#: Setting of the session: where op9_secrets keeps its ledger from run to run. Unset, each run begins one of its own.
LEDGER_SETTING = "tallyforge.secrets.ledger"


@dataclass(frozen=True)
class Rule:
    """A pattern over UTF-8 bytes. A match counts if ``group`` has ``least`` characters or more; it is used up either way."""

    name: str
    version: int
    pattern: bytes
    least: int = 0
    group: int = 0
    #: One of these, in lower case, is in every text that matches; empty: any text may.
    hints: tuple[bytes, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: Kinds that every scan finds. A run of characters of one class is one match, so its least length can stand in the pattern.
BASE = (
    Rule("assign", 1, rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")),
    Rule("access", 1, rb"AKIA[A-Z0-9]{16,}", 20, 0, (b"akia",)),
    Rule("hex", 1, rb"[0-9a-f]{24,}", 24),
)
#: Kinds that are added to them.
ADDED = (
    Rule("pem", 1, rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0, 0, (b"private key-----",)),
    Rule("jwt", 1, rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, (b"eyj",)),
    Rule("prefixed", 1, rb"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,})", 0, 0, (b"_", b"xox")),
    Rule("userinfo", 1, rb"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{6,128}@[A-Za-z0-9.-]+", 0, 0, (b"://",)),
)
RULES = BASE + ADDED


def find(text: bytes | None, rules: tuple[Rule, ...], compiled: dict[str, re.Pattern[bytes]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then by the order of ``rules``; leftmost and not overlapping within a kind."""
    if not text:
        return []
    low, found = text.lower(), []
    for order, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in compiled[rule.key].finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end(), rule.name))
    if not found:
        return []
    point, at, points = {}, 0, 0
    for stop in sorted({x for a, _, b, _ in found for x in (a, b)}):
        points += len(text[at:stop].decode("utf-8", "replace"))
        point[stop], at = points, stop
    return [(point[a], point[b], name) for a, _, b, name in sorted(found)]


def blob_id(text: Column) -> Column:
    """SHA-256 of the content; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, spans): what the blobs of ``versions`` still need, scanned now and written to the shared folder.

    ``ledger`` holds such rows of earlier scans, one or more per blob. A blob
    is scanned only with the rule versions that none of its rows names; one
    that has them all gives no row. Copies meet before the scan: they are
    merged within each task first, so a content that a third of all rows hold
    reaches its task once per sender.
    """
    keys = [r.key for r in rules]
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("rules", F.array(*map(F.lit, keys)))
    else:
        seen = ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0).select("blob", "text", "rules")
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.key: re.compile(r.pattern) for r in rules}
        for batch in arrow_rows(batches):
            spans = []
            for body, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in find(body, tuple(r for r in rules if r.key in wanted), compiled)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, kinds)], names=["blob", "rules", "spans"])

    small_batches(versions.sparkSession)
    return materialize(todo.mapInArrow(run, LEDGER), "secrets-ledger")


def findings(versions: DataFrame, ledger: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``keep`` and spans for every row of ``versions``: what the ledger has of its content under these rules, by start, then rule order.

    Rows of one path at several times each get their own content's spans.
    Contents without a finding are not joined, so the joined side is small.
    """
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    current = reduce(lambda a, b: a | b, (F.array_contains("rules", r.key) for r in rules))
    hits = ledger.where(current & (F.size("spans") > 0)).select("blob", "rules", F.explode("spans").alias("s"))
    # a row may be current by one rule and stale by another
    key = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.key)))
    hits = hits.where(F.coalesce(F.array_contains("rules", F.element_at(key, F.col("s.kind"))), F.lit(False)))
    sets = hits.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("s.start", F.element_at(order, F.col("s.kind")).alias("o"), "s.end", "s.kind"))).alias("sorted"))
    sets = materialize(sets.select("blob", F.transform("sorted", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans")), "secrets-found")
    ids = versions.select(F.struct(*keep).alias("_row"), blob_id(F.col(text)).alias("blob"))
    return ids.join(sets, "blob", "left").select("_row.*", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scanned(docs: DataFrame, keep: list[str] | None = None, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` (doc_id by default) and spans for every row of ``docs``.

    Null and empty texts have none; texts of any length are scanned whole;
    equal texts and repeated rows have the same; no document gives no row;
    other columns are ignored, whatever their names.
    """
    new = scan(docs, ledger, rules)
    return findings(docs, new if ledger is None else ledger.unionByName(new), keep or ["doc_id"], rules)


def kept_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger at ``path``, after what ``versions`` still needs has been scanned and appended to it.

    A first call begins the ledger; a later one scans only blobs and rule
    versions that it does not name, so the same rows again scan nothing. A job
    that dies before its append leaves the ledger as it was. One writer at a
    time.
    """
    spark = versions.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    new = scan(versions, spark.read.schema(LEDGER).parquet(path) if known else None, rules, text)
    if not known or new.head(1):
        new.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<kind>``; of overlapping spans the first counts."""
    free = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    return F.when(F.size(spans) > 0, F.concat(free["out"], F.substring(text, free["at"] + 1, F.length(text)))).otherwise(text)


def redacted(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every secret in text replaced by its kind; n_chars, where there is one, follows.

    Null and empty texts stay as they are; repeated rows come out alike; no
    document gives no row; all columns stay, whatever their names.
    """
    packed = docs.select(F.struct("*").alias("_row"), "text")
    found = scanned(packed, ["_row"], ledger, rules)
    some = F.size("spans") > 0
    found = found.withColumn("_text", redact(F.col("_row.text"), F.col("spans")))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(some, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), spark.conf.get(LEDGER_SETTING, None)
    found = findings(docs, kept_ledger(docs, path), ["doc_id"]) if path else scanned(docs)
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.name) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
