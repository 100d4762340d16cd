"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and BK-trees find pairs, MinHash bands and leading shingles those beyond their radius; the texts confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, components, discard, materialize, small_batches, text_bytes
from tallyforge.llm.simhash import body_hash, candidates, keep_first, majority

#: Words of a shingle, and the similarity from which two texts are linked, in tenths.
WIDTH, TENTHS = 5, 8
#: Bits in which SimHashes of paired texts differ at most. Two sets of similarity 0.9 differ in 6.6 bits of 64 on average, of 0.8 in 9.7;
#: at a radius of 7 a tree's entries go down most of it, which took over a minute for 65,536 of them.
RADIUS = 4
#: Two texts of similarity s share no band with probability (1 - s ** ROWS) ** BANDS: 5e-6 at 0.8.
BANDS, ROWS = 40, 6
#: Shingles that a task keeps, so that a text of many pairs is cut once.
KEPT = 1 << 21

_rng = np.random.default_rng(42)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (A-Z lower-cased); a text of fewer words is one shingle, one of none has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=max(1, len(words) - width + 1)))


def bands(found: np.ndarray) -> np.ndarray:
    """One number per band, from the least of its permuted shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return ((least >> np.uint64(7)).reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * both >= TENTHS * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, body, key, size, fp, bands): key is a hash of the set of shingles, so that equal sets share it; fp its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in arrow_rows(batches):
            keys, sizes, prints, rows = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                keys.append(xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prints.append(majority(found.astype(">u8")))
                rows.append(bands(found))
            numbers = pa.array(np.concatenate(rows).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), numbers)
            columns = [*batch.columns[:2], pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "body", "key", "size", "fp", "bands"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", body_hash().alias("body"), text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, body long, key long, size long, fp long, bands array<long>")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, np.ndarray] = {}
    held = 0

    def cut(key: int, text: pa.Scalar) -> np.ndarray:
        nonlocal held
        found = kept.get(key)
        if found is None:
            found = shingles(text.as_py())
            if held > KEPT:
                kept.clear()
                held = 0
            kept[key] = found
            held += len(found)
        return found

    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)
        hits = [(a, b) for a, b, left, right in pairs if similar(cut(a, left), cut(b, right))]
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*hits, strict=True)], names=["u", "v"])


def texts_of(keys: DataFrame, reps: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """(key, text): one text of each of ``keys`` (key), written to the shared folder."""
    named = reps.join(keys.distinct(), "key", "left_semi").select("key", "least.*")
    rows = docs.select(F.col("doc_id").alias("_id"), body_hash().alias("_hash"), text_bytes().alias("text"))
    on = [F.col("_id").eqNullSafe(F.col("doc_id")), F.col("_hash") == F.col("body")]
    # repeated rows have one text; the first is as good as any
    return materialize(rows.join(named, on).groupBy("key").agg(F.first("text").alias("text")), tag)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): the pairs (a, b) of keys whose texts are similar."""
    texts = texts_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), reps, docs, "neardup-texts")
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("right"))
    small_batches(docs.sparkSession)
    found = materialize(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_confirm, "u long, v long"), "neardup-links")
    discard(texts)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = shingles(text.as_py()).view(np.int64)
            n = len(found)
            for at in range(0, n, _CUT):
                part = found[at : at + _CUT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(np.full(len(part), n)), pa.array(part)], names=["key", "size", "shingle"])


#: Shingles of one batch that leaves a task.
_CUT = 1 << 16
#: Sizes of one class are within this factor.
_CLASS = 1.05


def _class(size: str) -> str:
    return f"cast(floor(ln({size}) / {float(np.log(_CLASS))!r}) as int)"


def _fits(a: str, b: str) -> str:
    """Whether sets of these sizes can be similar at all."""
    return f"10 * least({a}, {b}) >= {TENTHS} * greatest({a}, {b})"


def leading(live: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(shingle, cls, other, low, high, key, size, root, pos): of each text of ``live`` (key, root) the shingles that a similar one may share first.

    Shingles are put in one order, the rarest first. If two texts have o
    shingles in common, the first of these is at most at place size - o + 1 of
    either; 9 o is 4 times the sum of their sizes or more where the similarity
    is 0.8. How far a text's leading shingles reach so follows from the other's
    size: there is a row for every class of sizes that the other may have.
    Shingles of one text alone only take up places.
    """
    small_batches(docs.sparkSession)
    texts = texts_of(live.select("key"), reps, docs, "neardup-live-texts")
    cut = materialize(texts.mapInArrow(_cut, "key long, size long, shingle long"), "neardup-shingles")
    discard(texts)
    times = cut.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    place = F.row_number().over(Window.partitionBy("key").orderBy("times", "shingle"))
    shared = cut.join(times, "shingle").select("key", "size", "shingle", (place + F.col("size") - F.count("*").over(Window.partitionBy("key"))).alias("pos"))
    shared = shared.where(f"10 * (size - pos + 1) >= {TENTHS} * size").withColumn("cls", F.expr(_class("size")))
    least, most = _class(f"greatest(ceil({TENTHS} * size / 10), 1)"), _class(f"floor(10 * size / {TENTHS})")
    rows = shared.withColumn("other", F.explode(F.sequence(F.expr(f"{least} - 1"), F.expr(f"{most} + 1"))))
    # the least size of the other class, or somewhat less
    other = F.greatest(F.ceil(F.col("size") * TENTHS / 10), F.ceil(F.pow(F.lit(_CLASS), F.col("other"))) - 1)
    rows = rows.where(9 * (F.col("size") - F.col("pos") + 1) >= 4 * (F.col("size") + other)).join(live, "key").select("shingle", "cls", "other", "key", "size", "root", "pos")
    rows = materialize(rows.withColumns({"low": F.least("cls", "other"), "high": F.greatest("cls", "other")}), "neardup-leading")
    discard(cut)
    return rows


def _split(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and most: the commonest root of each bucket that has several."""
    roots = rows.groupBy(*by, "root").agg(F.count("*").alias("_n"))
    return roots.groupBy(*by).agg(F.max_by("root", F.struct("_n", "root")).alias("most"), F.count("*").alias("_roots")).where("_roots > 1").drop("_roots")


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v): pairs of keys whose SimHashes are within RADIUS and whose texts are similar, as BK-trees find them: one or a few for each key."""
    pairs, sizes = candidates(reps.select("key", "size", "fp"), RADIUS), reps.select("key", "size")
    left, right = sizes.toDF("a", "size"), sizes.toDF("b", "_size")
    fit = materialize(pairs.join(left, "a").join(right, "b").where(_fits("size", "_size")).select("a", "b"), "neardup-near")
    discard(pairs)
    return confirmed(fit, reps, docs)


def links(docs: DataFrame, reps: DataFrame, near: DataFrame | None = None) -> DataFrame | None:
    """(u, v): every key but the smallest of each component, with that smallest key; None if no two texts share a band.

    ``near`` (u, v) are links that are known, those of SimHash. Where texts of
    several components share a bucket, each is compared with one text of each
    of its buckets, that whose buckets are the fullest: in a group of edited
    copies the copies of copies have emptier ones. That links most of a large
    group by a pair or two a text. What shares a bucket and is not linked then
    is joined by its leading shingles, which loses no pair, and of which texts
    that differ in too many places have none in common, however large their
    group. There too only those outside the commonest component are compared
    with others.
    """
    roots = None if near is None else components(near, "neardup-components")

    def rooted(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("key"))
        return df.join(roots, df["key"] == roots["u"], "left").select(*df.columns, F.coalesce("v", "key").alias("root"))

    keyed = reps.select("key", "size", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("bucket"), "key", "size")
    keyed = materialize(keyed, "neardup-buckets")
    full = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    known = materialize(rooted(keyed.join(full, "bucket")), "neardup-known")
    discard(keyed)
    shared = materialize(known.join(_split(known, ["bucket"]).select("bucket"), "bucket"), "neardup-shared")
    discard(known)
    if not shared.head(1):
        return roots
    rank = materialize(shared.groupBy("key").agg(F.sum("n").alias("rank")), "neardup-rank")
    plain, shared = shared, materialize(shared.select("bucket", "key", "size", "root").join(rank, "key"), "neardup-ranked")
    discard(plain, rank)
    chief = shared.groupBy("bucket").agg(F.max(F.struct("rank", F.negate("key").alias("_less"), "key", "size", "root")).alias("c"))
    chief = chief.select("bucket", F.col("c.key").alias("_key"), F.col("c.size").alias("_size"), F.col("c.root").alias("_root"))
    pairs = shared.join(chief, "bucket").where(f"root <> _root and {_fits('size', '_size')}").select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()
    pairs = materialize(pairs, "neardup-pairs")
    edges = confirmed(pairs, reps, docs)
    edges = edges if near is None else near.union(edges)
    roots = components(edges, "neardup-components")
    live = materialize(rooted(shared.select("bucket", "key")), "neardup-rooted")
    open_ = live.join(_split(live, ["bucket"]).select("bucket"), "bucket", "left_semi")
    open_ = materialize(open_.select("key", "root").distinct(), "neardup-open")
    discard(shared, live)
    if not open_.head(1):
        return roots
    every, by = leading(open_, reps, docs), ["shingle", "low", "high"]
    rows = materialize(every.join(_split(every, by), by), "neardup-split")
    discard(every)
    outside = rows.where("root <> most").select("shingle", F.col("cls").alias("other"), F.col("other").alias("cls"), F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("root").alias("_root"), F.col("pos").alias("_pos"))
    reach = "9 * least(size - pos + 1, _size - _pos + 1) >= 4 * (size + _size)"
    more = rows.join(outside, ["shingle", "cls", "other"]).where(f"root <> _root and {reach}").select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "neardup-more")
    discard(rows, open_, pairs)
    if not more.head(1):
        return roots
    return components(edges.union(confirmed(more, reps, docs)), "neardup-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, body, group, component_id): documents of a similarity of 0.8 or more are linked; columns as those of simhash.near_duplicates.

    Texts without words, null ones too, are equal to each other and to nothing
    else; of any length texts are cut whole; repeated rows and equal texts are
    in one group; no document gives no row; other columns are ignored, whatever
    their names.
    """
    prints = materialize(sketches(docs), "neardup-sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "body"))
    reps = prints.groupBy("key").agg(least.alias("least"), *(F.first(c).alias(c) for c in ("size", "fp", "bands")))
    reps = materialize(reps, "neardup-reps")
    named, roots = reps.select("key", F.col("least.doc_id").alias("rep")), links(docs, reps, near_links(docs, reps))
    labelled = named.withColumn("group", F.col("key"))
    if roots is not None:
        labelled = materialize(named.join(roots, named["key"] == roots["u"], "left").select("key", "rep", F.coalesce("v", "key").alias("group")), "neardup-groups")
    least = materialize(labelled.groupBy("group").agg(F.min("rep").alias("component_id")), "neardup-least")
    labels = materialize(labelled.join(least, "group").select("key", "group", "component_id"), "neardup-labels")
    return prints.select("doc_id", "body", "key").join(labels, "key").select("doc_id", "body", "group", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group, as simhash.first_of_each takes them."""
    return keep_first(docs, near_duplicates(docs))
