"""Personal data: base patterns, and spans added by labelers whose votes are weighed by expectation-maximisation.

DataFrame and SQL operations only. The driver works on a table of vote
patterns, whose size the labelers bound, never on documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import materialize, table

SPAN = "struct<start:int,end:int>"

# The base kinds in order, their patterns, and the character that every match has.
# Possessive forms and look-behinds match the same as the plain ones, in time linear in the text.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
# Patterns of what may be personal data too, and the text that hints at it.
CANDIDATES = {
    "ssn": (r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    "phone_local": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", ""),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ""),
    "email_text": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z]{2,12}(?![A-Za-z0-9])", "dot"),
}
# The gazetteers, and words in front of a span that speak for or against it.
COUNTRIES = "AD AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IT LI LT LU LV MC MT NL NO PL PT RO RS SE SI SK TR".split()
DOMAINS = "com org net edu gov info io de fr es it uk eu co".split()
FOR = r"(?i)\b(?:e-?mail|mail|phone|tel|call|mobile|cell|fax|contact|reach|write|ssn|social|security|iban|account|konto|correo|courriel|telefon|name|born)\b"
AGAINST = r"(?i)\b(?:version|build|order|invoice|isbn|issn|item|part|page|model|ticket|serial|ref|code|figure|table|section|chapter|look|meet)\b"
#: Characters in front of a span that the context labelers see.
CONTEXT = 48
LABELERS = ["form", "gazetteer", "context_for", "context_against"]


def occurrences(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, end, match>> in code points, leftmost and not overlapping; the end is exclusive."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,match:string>>"
    walked = F.aggregate(
        F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("match")))).cast(kind).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    there = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    return F.when(there, walked).otherwise(F.array().cast(kind))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _valid_match(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["match"])


def _form(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ssn":
        good = ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^...00|0000$")
    elif kind == "phone_local":
        good = digits.rlike("^[2-9]..[2-9]")
    elif kind == "iban":
        good = F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (F.length(digits) >= 10)
    else:
        good = m.rlike(r"[\[(]")
    return F.when(good, 1).otherwise(-1)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "iban":
        return F.when(F.substring(m, 1, 2).isin(COUNTRIES), 1).otherwise(-1)
    if kind == "email_text":
        return F.when(F.lower(F.regexp_extract(m, "[A-Za-z]+$", 0)).isin(DOMAINS), 1).otherwise(-1)
    return F.lit(0)


def _candidates(text: Column) -> Column:
    """All candidate spans with each labeler's vote (1, 0 or -1) and the number of digits."""
    return F.concat(*(F.transform(occurrences(text, pattern, hint), _voted(text, kind)) for kind, (pattern, hint) in CANDIDATES.items()))


def _voted(text: Column, kind: str) -> Callable[[Column], Column]:
    def voted(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        return F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            _form(kind, x["match"]).alias("form"),
            _gazetteer(kind, x["match"]).alias("gazetteer"),
            F.when(before.rlike(FOR), 1).otherwise(0).alias("context_for"),
            F.when(before.rlike(AGAINST), -1).otherwise(0).alias("context_against"),
            F.least(F.length(_digits(x["match"])), F.lit(20)).alias("digits"),
        )

    return voted


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, an array of base spans per kind, and the candidates that overlap none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit, none = text.rlike("[0-9]"), F.array().cast(f"array<{SPAN}>")
    base = []
    for kind, (pattern, hint) in BASE.items():
        found = F.transform(F.filter(occurrences(text, pattern, hint), _valid_match(kind)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        base.append((found if kind == "email" else F.when(digit, found).otherwise(none)).alias(kind))
    candidates = _candidates(text)
    kinds = "array<struct<kind:string,start:int,end:int,form:int,gazetteer:int,context_for:int,context_against:int,digits:int>>"
    candidates = F.when(digit | F.contains(text, F.lit("dot")), candidates.cast(kinds)).otherwise(F.array().cast(kinds))
    out = docs.select(*keep, *base, candidates.alias("candidates"))
    taken = F.concat(*(F.col(k) for k in BASE))
    return out.withColumn("candidates", F.filter("candidates", lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))


@dataclass(frozen=True)
class Classifier:
    """Logistic weights over a candidate's kind, votes and digits; ``reliability`` is each labeler's estimated accuracy."""

    reliability: dict[str, float]
    weights: dict[str, float]
    least: float = 0.9

    def column(self, c: Column) -> Column:
        """Whether a candidate is personal data: likely enough, and with more votes for it than against."""
        z = F.lit(self.weights["bias"])
        for kind in CANDIDATES:
            z = z + F.when(c["kind"] == kind, self.weights[f"kind:{kind}"]).otherwise(0.0)
        for name in LABELERS:
            z = z + c[name] * F.lit(self.weights[name])
        z = z + c["digits"] / 20.0 * F.lit(self.weights["digits"])
        return (z > float(np.log(self.least / (1 - self.least)))) & (sum((c[x] for x in LABELERS), F.lit(0)) > 0)


def fit(votes: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 50, least: float = 0.9) -> Classifier:
    """From (kind, votes, digits, times): labelers' reliabilities by EM, then a classifier trained on the posteriors.

    Each labeler votes right with its own probability where it votes; kinds
    have priors of their own. Reliabilities begin at 0.8 and stay within 0.55
    and 0.99, so that no labeler is turned round. Without votes the classifier
    is the sum of the first reliabilities' log odds.
    """
    kinds = list(CANDIDATES)
    v = np.array([x[1] for x in votes], float).reshape(-1, len(LABELERS))
    k = np.array([kinds.index(x[0]) for x in votes], int)
    d, w = np.array([x[2] for x in votes], float) / 20.0, np.array([x[3] for x in votes], float)
    right, prior = np.full(len(LABELERS), 0.8), np.full(len(kinds), 0.5)
    post = np.full(len(v), 0.5)
    for _ in range(rounds):
        odds = np.log(right / (1 - right))
        z = v @ odds + np.log(prior / (1 - prior))[k]
        post = 1 / (1 + np.exp(-z))
        for j in range(len(LABELERS)):
            some = w * (v[:, j] != 0)
            agree = (some * np.where(v[:, j] > 0, post, 1 - post)).sum()
            right[j] = np.clip((agree + 8.0) / (some.sum() + 10.0), 0.55, 0.99)
        for j in range(len(kinds)):
            prior[j] = np.clip(((w * post)[k == j].sum() + 1.0) / (w[k == j].sum() + 2.0), 0.05, 0.95)
    names = ["bias", *(f"kind:{x}" for x in kinds), *LABELERS, "digits"]
    odds = np.log(right / (1 - right))
    beta = np.concatenate([[0.0], np.log(prior / (1 - prior)), odds, [0.0]])
    if len(v):
        x = np.concatenate([np.ones((len(v), 1)), np.eye(len(kinds))[k], v, d[:, None]], axis=1)
        start, scale = beta.copy(), w / w.sum()
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
            beta = beta - 0.5 * np.linalg.solve(h, x.T @ (scale * (p - post)) + 0.01 * (beta - start))
    return Classifier(dict(zip(LABELERS, map(float, right), strict=True)), dict(zip(names, map(float, beta), strict=True)), least)


def found(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default), email, ip, card, phone (array<struct<start, end>>) and added (with kind) for every row of ``docs``.

    A null text counts as empty and has no span; a match that fails its test is
    used up; texts of any length are searched whole; equal texts and repeated
    rows come out alike; without candidates nothing is added; no document gives no row; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    rows = materialize(spans(docs, keep), "pii-spans")
    patterns = rows.select(F.explode("candidates").alias("c")).groupBy("c.kind", *(f"c.{x}" for x in LABELERS), "c.digits").agg(F.count("*").alias("times"))
    votes = [(r["kind"], tuple(r[x] for x in LABELERS), r["digits"], r["times"]) for r in patterns.collect()]  # kinds x 36 x 21 rows at most
    model = fit(sorted(votes))
    return rows.select(*keep, *BASE, F.filter("candidates", model.column).alias("added"))


def told(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents"))
    base = F.concat(*(F.transform(k, told(k)) for k in BASE))
    added = F.concat(*(F.transform(F.filter("added", _of(k)), told(k)) for k in CANDIDATES))
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"), F.size(F.concat(base, added)).cast("long").alias("n_spans"))
