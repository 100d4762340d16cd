"""Token counts: an exact histogram of encoded lengths that answers every context limit."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, small_batches, table, text_bytes

#: Bytes, about, that a Python worker keeps of words' ids and again of pieces' ids; at more it starts anew.
CACHE_BYTES = 96 << 20
#: Bytes of a word that is kept, at most; longer ones hardly come twice.
LONG_WORD = 32
#: Bytes of an entry: key, value and slot.
_ENTRY = 240

#: A word whose pieces are sure: letters that have one lower-case form, then marks that join no contraction.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|*#$%&()\\[\\]\"-]*)")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """What words gave; an unknown one is worked out when it is asked for. Holds about ``most`` bytes, then starts anew."""

    def __init__(self, find: Callable[[bytes | str], object], most: int):
        super().__init__()
        self.find, self.most = find, most // _ENTRY

    def __missing__(self, word: bytes | str) -> object:
        out = self.find(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


class WordCache:
    """Encodes texts word by word and keeps what each word gave.

    Right for tokenizers that split at white space and drop it, ignore case and
    split letters from marks, as ``word_bpe_49k.json`` does: the ids of a text
    are those of its words in turn, and a plain word's those of its letters and
    its marks. Other words go through the whole tokenizer. ``make`` turns ids
    into what is kept, which adds up as the ids do.
    """

    def __init__(self, path: str, make: Callable[[list[int]], object], most: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.make = Tokenizer.from_file(path), make
        self.letters = _byte_letters()
        self.known, self.pieces = _Known(self._word, most), _Known(self._piece, most)

    def _piece(self, piece: str) -> object:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return self.make([t.id for t in self.tokenizer.model.tokenize(shown)] if piece else [])

    def _word(self, word: bytes) -> object:
        text = word.decode("utf-8", "replace")
        m = _PLAIN.fullmatch(text)
        if m:
            return self.pieces[m[1].lower()] + self.pieces[m[2]]
        return self.make(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _kept(self, text: bytes | None) -> Iterator[object]:
        return map(self.known.__getitem__, text.split() if text else [])

    def ids(self, text: bytes | None) -> bytes:
        """The ids of a text, four little-endian bytes each."""
        return b"".join(self._kept(text))

    def count(self, text: bytes | None) -> int:
        return sum(self._kept(text))


_CACHES: dict[tuple[str, str], WordCache] = {}


def word_cache(path: str, make: Callable[[list[int]], object]) -> WordCache:
    """The cache of this Python worker, which later tasks of the worker use again."""
    key = (path, make.__name__)
    if key not in _CACHES:
        _CACHES[key] = WordCache(path, make)
    return _CACHES[key]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row (n_tokens long) per row of ``docs``; a null or empty text has 0 tokens.

    Texts are encoded whole, whatever their length; equal texts and repeated
    rows count each by itself; no document gives no row; other columns are
    ignored, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer, len)
        for batch in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([cache.count(x.as_py()) for x in batch.column(0)], pa.int64())], names=["n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(text_bytes(text).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Exact histogram of ``n_tokens`` with suffix sums; one row per length that occurs.

    For each row, read as a context limit of ``n_tokens``: ``docs_longer`` and
    ``tokens_longer`` count documents over the limit and all their tokens,
    ``tokens_within`` those of documents that fit, ``tokens_truncated`` what is
    left when each document is cut to the limit, and ``quantile`` the share of
    documents that fit. An empty input gives no row. Lengths are put in blocks
    of 256, so that no window has more than 256 rows of one block, or one row
    per block.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.expr("n_tokens div 256"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("b_docs", "b_tokens")), *(F.sum(c).over(whole).alias(f"all_{c[2:]}") for c in ("b_docs", "b_tokens")))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("b_docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("b_tokens_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0))).alias("tokens_longer"),
        "all_docs",
        "all_tokens",
    )
    return longer.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row (docs_longer, tokens_truncated, tokens_within) for any limit, taken from the histogram alone."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(F.when(n > limit, docs)), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(docs * F.least(n, F.lit(limit))), F.lit(0)).alias("tokens_truncated"),
        F.coalesce(F.sum(F.when(n <= limit, docs * n)), F.lit(0)).alias("tokens_within"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(table(spark, sf_dir, "documents"), word_bpe()))
