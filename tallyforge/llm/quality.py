"""Quality rules: a decision list learned from labelled text statistics, applied as Spark conditions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, small_batches, table, text_bytes

#: Labelled documents that a list is learned from, at most; chosen by hash of doc_id.
TRAIN_ROWS = 8192

_SYMBOLS = b"#*$%&|<>"
_SPACE = bytes([32, *range(9, 14)])
_LATER = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"

#: What is counted in a text; all long.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "longest_word"]


def _repeated(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    starts = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
    return int(np.minimum(np.diff(starts), width).sum()) + width


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text; a null text counts as empty."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    return (
        len(words),
        len(text.translate(None, _SPACE + _LATER)),
        size - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(set(words)),
        size - len(text.translate(None, _UPPER)),
        size - len(text.translate(None, _DIGITS)),
        size - len(text.translate(None, _MARKS)),
        max(map(len, words), default=0),
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text among them or not) as kept_0, kept_1 and so on, and the COUNTS of text, in one pass.

    Text goes to Python once, as bytes, and comes back from there if it is kept.
    """
    others, back = [c for c in keep if c != "text"], "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            counts = np.array([statistics(x.as_py()) for x in batch.column(batch.num_columns - 1)], dtype=np.int64).reshape(-1, len(COUNTS))
            kept = batch.columns if back else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=names)

    kinds = dict(docs.dtypes)
    names = [*(f"k{i}" for i in range(len(others))), *(["text"] if back else []), *COUNTS]
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(others)), *(["text binary"] if back else []), *(f"{c} long" for c in COUNTS)])
    small_batches(docs.sparkSession)
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(others)), text_bytes().alias("text")).mapInArrow(run, schema)
    kept = [F.col("text").cast(kinds["text"]) if c == "text" else F.col(f"k{others.index(c)}") for c in keep]
    return out.select(*(c.alias(f"kept_{i}") for i, c in enumerate(kept)), *COUNTS)


def _features() -> dict[str, Column]:
    """What conditions test, from the COUNTS."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "distinct_share": per("n_distinct", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "longest_word": F.col("longest_word").cast("double"),
    }


FEATURES = ["n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "distinct_share", "upper_share", "digit_share", "marks_per_word", "longest_word"]


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (feature, '<=' or '>=', threshold) hold: the text is rejected."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def matches(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, sign, at in self.tests:
            hit &= x[:, names.index(name)] <= at if sign == "<=" else x[:, names.index(name)] >= at
        return hit

    def column(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out &= features[name] <= at if sign == "<=" else features[name] >= at
        return out


def _hit(x: np.ndarray, test: tuple[int, str, float]) -> np.ndarray:
    return x[:, test[0]] <= test[2] if test[1] == "<=" else x[:, test[0]] >= test[2]


def _grow(x: np.ndarray, bad: np.ndarray, most_tests: int, cuts: int) -> list[tuple[int, str, float]]:
    """Add the test of most information gain until no good row is covered; thresholds are quantiles of all rows and of bad ones."""
    inside, tests = np.ones(len(x), bool), []
    while len(tests) < most_tests:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (0.0, None)
        rows, target = x[inside], bad[inside]
        for f in range(x.shape[1]):
            for at in np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts), method="nearest") for v in (rows[:, f], rows[target, f])])):
                for sign in ("<=", ">="):
                    hit = _hit(rows, (f, sign, at))
                    good = int(hit.sum())
                    both = int(target[hit].sum())
                    if both and good < len(rows):
                        gain = both * (np.log2(both / good) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, sign, float(at)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _hit(x, best[1])
    return tests


def _prune(tests: list[tuple[int, str, float]], x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """The leading tests that do best on rows not used to grow them."""
    best, keep, inside = -2.0, len(tests), np.ones(len(x), bool)
    for i, test in enumerate(tests, 1):
        inside = inside & _hit(x, test)
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-9:
            best, keep = worth, i
    return tests[:keep]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.98, least: int = 8, most_rules: int = 24, most_tests: int = 4, cuts: int = 33) -> list[Rule]:
    """Sequential covering: rules that reject, in order.

    Two rows of three grow a conjunction, the third prunes it. A rule counts
    only if at least ``precision`` of what it covers is bad and it covers
    ``least`` rows; what it covers is then set aside. If it does not count,
    another third prunes, and then none; if nothing counts, the list ends. Any
    other text is kept.
    """
    rules: list[Rule] = []
    left = np.arange(len(x))
    while len(rules) < most_rules and bad[left].sum() >= least:
        for third, prunes in ((0, True), (1, True), (2, True), (0, False), (1, False), (2, False)):
            grow, prune = left[left % 3 != third], left[left % 3 == third]
            tests = _grow(x[grow], bad[grow], most_tests, cuts)
            tests = _prune(tests, x[prune], bad[prune]) if prunes else tests
            inside = np.full(len(left), bool(tests))
            for test in tests:
                inside &= _hit(x[left], test)
            covered, right = int(inside.sum()), int(bad[left][inside].sum())
            if covered >= least and right >= precision * covered:
                break
        else:
            break
        rules.append(Rule(tuple((names[f], sign, at) for f, sign, at in tests), right / covered, covered))
        left = left[~inside]
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and verdicts (True: bad) of at most ``most`` labelled documents, chosen by hash of doc_id.

    Null labels, and documents labelled both ways, are left out; of repeated
    rows of a doc_id the largest of each feature counts.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = with_statistics(named, ["doc_id", "quality"])
    features = _features()
    rows = stats.select("kept_0", "kept_1", *(features[f].alias(f) for f in FEATURES)).groupBy("kept_0").agg(F.first("kept_1").alias("quality"), *(F.max(f).alias(f) for f in FEATURES))
    got = rows.orderBy(F.xxhash64("kept_0"), "kept_0").toPandas()
    return got[FEATURES].to_numpy(dtype=float), (got["quality"] == 0).to_numpy(dtype=bool)


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out, features = None, _features()
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(features), F.lit(i)) if out is None else out.when(rule.column(features), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """``keep`` (doc_id by default), the COUNTS, base_failed, rule and kept for every row of ``docs``.

    base_failed: under 10 words, or over a fifth of them in repeated 5-word
    windows. kept: not base_failed, and no learned rule holds. Null and empty
    texts have no words and so fail; without labels there is no rule; ties
    between tests go to the first feature and least threshold; repeated rows
    are judged alike; texts of any length are counted whole; no document gives
    no row; other columns are ignored, whatever their names.
    """
    keep = keep or ["doc_id"]
    rules = learn(*training_rows(docs, labels, most), FEATURES)
    stats = with_statistics(docs, keep)
    failed, first = _base_failed(), decision(rules)
    return stats.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), *COUNTS, failed.alias("base_failed"), first.alias("rule"), (~failed & first.isNull()).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns whatever their names; of repeated rows all or none."""
    rules = learn(*training_rows(docs, labels, most), FEATURES)
    stats = with_statistics(docs, docs.columns)
    return stats.where(~_base_failed() & decision(rules).isNull()).select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
