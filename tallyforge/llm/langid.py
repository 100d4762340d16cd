"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, small_batches, table, text_bytes

#: Documents of a language that are learned from, in expectation at most; chosen by hash of doc_id.
TRAIN_DOCS = 1500
#: Hash buckets of character n-grams; bounds the model, and what is sent to the driver, per language.
BUCKETS = 1 << 15
#: What it costs to change the language between two words, in nats.
SWITCH = 6.0
#: Words whose scores a task keeps, and their letters.
CACHE_WORDS, CACHE_CHARS = 300_000, 1 << 22
#: Words of the documents that are walked together.
WALK_WORDS = 1 << 21
#: A script is a language's if this share of its letters' words is in it.
SCRIPT_SHARE = 0.01

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")

# First code points of the blocks that a script's letters are in, in order, and the script.
_STARTS = np.array([0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE70, 0xFF00, 0x20000])
_SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "kana", "han", "hangul", "other", "han", "other", "hangul", "other", "han", "other", "arabic", "arabic", "other", "han"]


def scripts_of(words: list[str]) -> np.ndarray:
    """The place in _SCRIPTS of each word's first letter."""
    return np.searchsorted(_STARTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1


def _grams(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first word, owner, buckets) of all characters of ``<word>`` after ``<word>``.

    ``owner`` counts words from the first of the block; a row of ``buckets`` has
    those of the 1- to 4-grams that begin at the character. 1-grams count
    beyond ASCII only. What is no gram is in bucket BUCKETS. A word may go on
    in the next block, so long ones take no more memory.
    """
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    for a in range(0, len(codes), _BLOCK):
        b = min(a + _BLOCK, len(codes))
        first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left"))
        owner = np.repeat(np.arange(last - first + 1), np.diff(np.r_[a, np.minimum(ends[first : last + 1], b)]))
        left = ends[first + owner] - np.arange(a, b)
        here = np.zeros(b - a + 3, np.uint64)
        here[: min(b + 3, len(codes)) - a] = codes[a : b + 3]
        hashed, out = here[: b - a].copy(), np.empty((b - a, 4), np.int32)
        out[:, 0] = np.where(hashed > 127, _bucket(hashed), BUCKETS)
        for n in range(2, 5):
            hashed = hashed * _STEP + here[n - 1 : n - 1 + b - a]
            out[:, n - 1] = np.where(left >= n, _bucket(hashed), BUCKETS)
        yield first, owner, out


_STEP, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Characters whose n-grams are looked up together.
_BLOCK = 1 << 16


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return ((hashed * _SPREAD) >> np.uint64(49)).astype(np.int32) % BUCKETS


def _whole(words: list[str]) -> np.ndarray:
    """The bucket of each word as a whole."""
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) % BUCKETS


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of n-gram buckets by language, each script's candidates, and the language of most documents."""

    languages: list[str]
    logs: np.ndarray  # BUCKETS + 1 x languages; the last row, of what is no n-gram, is 0
    candidates: np.ndarray  # scripts x languages
    common: int = 0

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats by word and language, whether the word is evidence at all).

        The best language has 0, others -8 at least, which those that the
        word's script rules out get. A word in a script that no language has is
        no evidence, and 0 for all.
        """
        allowed = self.candidates[scripts_of(words)]
        sums = self.logs[_whole(words)].copy()
        for first, owner, buckets in _grams(words):
            each = self.logs[buckets[:, 0]]
            for n in range(1, 4):
                each += self.logs[buckets[:, n]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums[first : first + len(starts)] += np.add.reduceat(each, starts, axis=0)
        known = allowed.any(axis=1)
        sums = np.where(allowed, sums / np.float32(3), -np.inf)
        best = np.where(known, sums.max(axis=1, initial=-np.inf), 0)[:, None]
        return np.where(known[:, None], np.maximum(sums - best, np.float32(-8)), 0).astype(np.float32), known


def _text(body: bytes | None) -> str:
    return body.decode("utf-8", "replace").lower() if body else ""


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model from the text and lang of ``docs``, of about ``most`` documents per language."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "lang", text_bytes().alias("text"))
    sizes = sorted((r["lang"], r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(_SCRIPTS), 0), bool))
    languages = [x for x, _ in sizes]
    share = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, most / n))))
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < F.element_at(share, F.col("lang")) * float(1 << 24))
    at = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        scripts: dict[int, np.ndarray] = {}
        for batch in arrow_rows(batches):
            words: dict[int, Counter[str]] = {}
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(at[lang], Counter()).update(_WORD.findall(_text(body)))
            for k, counts in words.items():
                total, seen = sums.setdefault(k, np.zeros(BUCKETS + 1, np.int64)), scripts.setdefault(k, np.zeros(len(_SCRIPTS), np.int64))
                found, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                if found:
                    np.add.at(total, _whole(found), times)
                    np.add.at(seen, scripts_of(found), times)
                    for first, owner, buckets in _grams(found):
                        total += np.bincount(buckets.ravel(), np.repeat(times[first + owner], 4), BUCKETS + 1).astype(np.int64)
        for k, total in sums.items():
            total[BUCKETS] = 0
            used, places = np.flatnonzero(total), np.flatnonzero(scripts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) + len(places), k, np.int32)), pa.array(np.r_[used, -1 - places].astype(np.int32)), pa.array(np.r_[total[used], scripts[k][places]])], names=["k", "bucket", "n"]
            )

    small_batches(docs.sparkSession)
    # buckets are counted from 0, scripts from -1 downwards
    counted = picked.select("lang", "text").mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    k, bucket, n = (counted[c].to_numpy(dtype=np.int64) for c in ("k", "bucket", "n"))
    grams = bucket >= 0
    table_ = np.zeros((BUCKETS, len(languages)))
    table_[bucket[grams], k[grams]] = n[grams]
    logs = np.log((table_ + 0.5) / (table_.sum(axis=0) + 0.5 * BUCKETS))
    scripts_ = np.zeros((len(_SCRIPTS), len(languages)))
    np.add.at(scripts_, (-1 - bucket[~grams], k[~grams]), n[~grams])
    candidates = (scripts_ > 0) & (scripts_ >= SCRIPT_SHARE * scripts_.sum(axis=0))
    for name in set(_SCRIPTS):  # a script may have several blocks
        alike = [i for i, x in enumerate(_SCRIPTS) if x == name]
        candidates[alike] = candidates[alike].any(axis=0)
    return Model(languages, np.r_[logs, np.zeros((1, len(languages)))].astype(np.float32), candidates, int(np.argmax([n for _, n in sizes])))


def viterbi(ids: np.ndarray, lengths: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word of several documents at once.

    ``ids``: rows of ``scores`` of all words, document after document, longest
    document first; all documents take a step together. Staying in a language
    is free, a change costs ``penalty``; of equals the first wins, and staying.
    """
    n, width = len(lengths), scores.shape[1]
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    best = np.zeros((n, width), np.float32)
    came = np.zeros(len(ids), np.int32)  # the best language before the word
    stay = np.zeros((len(ids), -(-width // 8)), np.uint8)  # a bit per language
    steps = int(lengths[0]) if n else 0
    active = n - np.searchsorted(lengths[::-1], np.arange(1, steps + 1), side="left")
    for t in range(steps):
        k = active[t]
        at = starts[:k] + t
        v = best[:k]
        if t:
            top = v.argmax(axis=1)
            jump = v[np.arange(k), top][:, None] - np.float32(penalty)
            keep = v >= jump
            came[at], stay[at] = top, np.packbits(keep, axis=1)
            v = np.maximum(v, jump)
        v = v + scores[ids[at]]
        best[:k] = v - v.max(axis=1, keepdims=True)
    path = np.zeros(len(ids), np.int32)
    now = best.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = now[:k]
        if t:
            stays = stay[at, now[:k] >> 3] >> (7 - (now[:k] & 7)) & 1
            now[:k] = np.where(stays, now[:k], came[at])
    return path


def _runs(path: np.ndarray, lengths: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Per document, runs (language, first word, end)."""
    at = 0
    for n in lengths:
        part = path[at : at + n]
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, n] if n else np.array([0])
        yield [(int(part[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        at += n


SPANS = "array<struct<lang:string,first:int,end:int>>"


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, penalty: float = SWITCH) -> DataFrame:
    """``keep`` (doc_id by default), lang_pred, score, spans for every row of ``docs``.

    spans: runs of words (letters only; first to end, counted from 0) with a
    language. Words in a script that no language uses are no evidence and go
    with their neighbours. lang_pred has the most letters of the other words
    in its spans, of equals the first by name; score is their share of all
    letters. A text of letters but no evidence has the language of most
    learned documents and score 0. A text that is null or has no letter is
    ``und`` with score 0 and no span, as is any text if nothing was learned.
    Texts of any length are walked whole; repeated rows come out alike; no
    document gives no row; other columns are ignored, whatever their names.
    """
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    names = [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "spans"]
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    walk = max(1, WALK_WORDS // (1 + len(model.languages) // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = {}, 0
        rows = np.zeros((0, max(1, len(model.languages))), np.float32)
        letters, told = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in arrow_rows(batches):
            if len(known) > CACHE_WORDS or held > CACHE_CHARS:
                known, held, rows, letters, told = {}, 0, rows[:0], letters[:0], told[:0]
            found = [_WORD.findall(_text(body)) if model.languages else [] for body in batch.column(batch.num_columns - 1).to_pylist()]
            new = list(set().union(*found).difference(known))
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                nats, evidence = model.scores(new)
                sizes = np.fromiter((len(w) if w.isascii() else sum(map(str.isalpha, w)) for w in new), np.int64, len(new))
                rows, letters, told = np.concatenate([rows, nats]), np.concatenate([letters, sizes]), np.concatenate([told, np.where(evidence, sizes, 0)])
                held += int(sizes.sum())
            word_ids = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in found]
            del found, new
            lengths = np.array([len(x) for x in word_ids], np.int64)
            order = np.argsort(-lengths, kind="stable")
            pred, score, spans = [None] * len(order), np.zeros(len(order)), [None] * len(order)
            ends = np.cumsum(lengths[order])
            begin = 0
            while begin < len(order):
                base = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, base + walk, side="right")))
                part = order[begin:stop]
                ids, sizes = np.concatenate([word_ids[i] for i in part]), lengths[part]
                path = viterbi(ids, sizes, rows, penalty) if len(ids) else np.empty(0, np.int32)
                doc = np.repeat(np.arange(len(part)), sizes)
                share = np.zeros((len(part), max(1, len(model.languages))))
                np.add.at(share, (doc, path), told[ids])
                total = np.bincount(doc, letters[ids], len(part))
                for j, (i, runs) in enumerate(zip(part, _runs(path, sizes), strict=True)):
                    if total[j]:
                        k = int(share[j].argmax()) if share[j].any() else model.common
                        pred[i], score[i] = model.languages[k], share[j, k] / total[j]
                        spans[i] = [{"lang": model.languages[a], "first": b, "end": c} for a, b, c in runs]
                    else:
                        pred[i], spans[i] = UNKNOWN, []
                begin = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(spans, span)], names=names)

    small_batches(docs.sparkSession)
    source = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), text_bytes().alias("text"))
    out = source.mapInArrow(run, ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "lang_pred string", "score double", f"spans {SPANS}"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "spans")


def held_out():
    """Documents that nothing is learned from: crc32 of doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
