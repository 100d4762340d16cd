"""A corpus pipeline: quality rules, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and hands it to the next. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import mixing, neardup, packing, quality, secretscan
from tallyforge.llm.common import materialize, table
from tallyforge.llm.tokens import word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep.

    A null or empty text has no words and goes; texts of any length are judged
    whole; repeated rows stay or go together; no document gives no row; all
    columns stay, whatever their names.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles of 0.8 or more): that of its smallest doc_id.

    Texts without words, null ones too, are one group; of repeated rows one
    stays; a row without doc_id stands only for a group that has no other;
    texts of any length are compared whole; no document gives no row; all
    columns stay, whatever their names.
    """
    return neardup.first_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind; n_chars follows.

    Null and empty texts stay; texts of any length are scanned whole; repeated
    rows come out alike; no document gives no row; all columns stay, whatever
    their names.
    """
    return secretscan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text, or one of no words, is not in it; a null source is a
    source of its own; repeated rows share a hash and go together; no document
    gives no row; all columns stay, whatever their names.
    """
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    A null or empty text is one piece of the closing id; only texts of over
    2048 ids are cut; repeated rows are packed each by itself; no document
    gives no row; other columns are ignored.
    """
    return packing.packed_documents(docs, word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: None: learned rules, components of similar texts and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None
