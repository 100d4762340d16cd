"""Near-duplicates by 64-bit SimHash, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, components, materialize, small_batches, star, table, text_bytes

#: Fingerprints of a shard; a larger one is split further.
SHARD = 1024
RADIUS = 2


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles (A-Z lower-cased, repeats included); 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return majority(np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype=">u8", count=max(1, len(words) - width + 1)))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (big-endian) have set; 0 for none."""
    ones, cells = np.zeros(64, np.int64), hashes.view(np.uint8)
    for at in range(0, len(cells), 8 << 14):
        ones += np.unpackbits(cells[at : at + (8 << 14)]).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, body, fp): the hash of the whole text, and the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            fps = np.fromiter((fingerprint(x, width, seed) for x in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "body", "fp"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", body_hash().alias("body"), text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, body long, fp long")


def body_hash() -> Column:
    """A hash of the text that tells rows of one doc_id apart; a null text's is 0."""
    return F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))


class BKForest:
    """BK-trees of many shards at once: every child hangs on its parent by their Hamming distance.

    ``shard`` and ``fp`` are arrays of one length. Trees grow level by level: of
    the entries that reach a node at one distance the first becomes the child
    and the rest go on below it.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        order = np.argsort(shard, kind="stable")
        self.fp, shard = fp[order].view(np.uint64), shard[order]
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, len(shard)]))
        at, left = self.root.copy(), np.setdiff1d(np.arange(len(shard)), first)
        codes, kids = [], []
        while len(left):
            code = at[left] * 65 + np.bitwise_count(self.fp[left] ^ self.fp[at[left]])
            edge, where, which = np.unique(code, return_index=True, return_inverse=True)
            child = left[where]
            codes.append(edge)
            kids.append(child)
            at[left] = child[which]
            left = left[at[left] != left]
        self.code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.kid = np.concatenate(kids) if kids else np.empty(0, np.int64)
        order = np.argsort(self.code)
        self.code, self.kid = self.code[order], self.kid[order]

    def links(self, radius: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries within ``radius``; only edges at distance d - radius to d + radius are followed."""
        for at in range(0, len(self.fp), block):
            query = np.arange(at, min(at + block, len(self.fp)))
            node = self.root[query]
            while len(query):
                d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
                hit = (d <= radius) & (query > node)
                if hit.any():
                    yield query[hit], node[hit]
                queries, nodes = [], []
                if len(self.code):
                    for step in range(-radius, radius + 1):
                        ok = (d + step >= 0) & (d + step <= 64)
                        want = node[ok] * 65 + d[ok] + step
                        place = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
                        found = self.code[place] == want
                        queries.append(query[ok][found])
                        nodes.append(self.kid[place[found]])
                query = np.concatenate(queries) if queries else np.empty(0, np.int64)
                node = np.concatenate(nodes) if nodes else query


#: Entries whose trees are built together; whole shards, as many as fit.
TOGETHER = 1 << 16


def _stars(forest: BKForest, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of the trees, shrunk to (fingerprint, least fingerprint reached)."""
    fp, u, v = forest.fp.view(np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for a, b in forest.links(radius):
        u, v = star(np.concatenate([u, fp[a]]), np.concatenate([v, fp[b]]))
    return u, v


#: Entries that look for their chief at once.
BLOCK = 1 << 10


def _chiefs(forest: BKForest, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry with a neighbour within ``radius``: the entry, and the neighbour that has the most itself.

    A pair for each entry and not for each link, of which a large group has its
    square; the trees are walked twice, so that links need not be held, and for
    few entries at once, as in a wide radius each goes down most of its tree.
    """
    n = len(forest.fp)
    times, best = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for a, b in forest.links(radius, BLOCK):
        times += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    order = times * n + np.arange(n)[::-1]
    for a, b in forest.links(radius, BLOCK):
        np.maximum.at(best, a, order[b])
        np.maximum.at(best, b, order[a])
    found = np.flatnonzero(best >= 0)
    fp = forest.fp.view(np.int64)
    return fp[found], fp[n - 1 - best[found] % n]


def _shard_links(radius: int, pairs=_stars):
    def linked(shard: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = pairs(BKForest(shard, fp), radius)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come shard after shard; the last shard may go on in the next batch
        shard, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            shard, fp = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((shard, fp)))
            if len(shard) >= TOGETHER:
                cut = int(np.searchsorted(shard, shard[-1]))
                yield from linked(shard[:cut], fp[:cut])
                shard, fp = shard[cut:], fp[cut:]
        yield from linked(shard, fp)

    return run


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that share the free bits among ``parts`` blocks."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD, rounds: int | None = None) -> DataFrame:
    """(shard, fp): fingerprints within ``radius`` of each other share one shard at least.

    The bits are cut into radius + 1 blocks; of two fingerprints within the
    radius one block is the same, so each value of a block is a shard. A shard
    of over ``most`` is split again by blocks of its other bits. As the other
    bits get fewer with each round, this ends, and no pair is lost.

    Each round makes radius + 1 rows of one, which a wide radius cannot afford
    for a large group of near copies. After ``rounds`` a shard that is still
    too large is dealt into several by a hash, and pairs between these are left
    to the caller.
    """
    parts, level, free = radius + 1, distinct.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path")), [(1 << 64) - 1]
    out = None
    while True:
        masks = [_blocks(f, parts) for f in free]
        wide = F.array(*(F.array(*(F.lit(_signed(m)) for m in row)) for row in masks))
        keyed = level.select("fp", "shard", "path", F.posexplode(F.get(wide, F.col("path"))).alias("block", "mask")).select(
            "fp", F.xxhash64("shard", "path", "block", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"), (F.col("path") * parts + F.col("block")).alias("path")
        )
        free = [f & ~m for f, row in zip(free, masks, strict=True) for m in row]
        left = max(bin(f).count("1") for f in free)
        if 1 << min(left, 62) <= most:
            hot = None
        else:
            hot = materialize(keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most), "simhash-hot")
            hot = hot if hot.head(1) else None
        rounds = rounds and rounds - 1
        if hot is not None and rounds == 0:
            piece = F.pmod(F.xxhash64(F.lit(7), "fp"), F.ceil(F.col("n") / most))
            keyed = keyed.join(hot, "shard", "left").select("fp", F.when(F.col("n").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", piece)).alias("shard"))
            hot = None
        done = keyed if hot is None else keyed.join(hot, "shard", "left_anti")
        out = done.select("shard", "fp") if out is None else out.union(done.select("shard", "fp"))
        if hot is None:
            return out
        level = materialize(keyed.join(hot, "shard", "left_semi"), "simhash-level")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, body, fp, group, component_id): documents whose fingerprints differ in ``radius`` bits at most are linked.

    group is the same for all that can be reached, component_id the smallest
    doc_id there. Null and empty texts have fingerprint 0 and link like any
    other; equal texts and repeated rows share a fingerprint and so a group; a
    null doc_id is no smallest one unless a group has no other; extra columns
    are ignored; no document gives no row; texts of any length are hashed
    whole. Copies are merged by fingerprint before any pair is looked at. The
    trees of a shard are built in the task that has the shard, a few at once:
    all trees together grow with the input, so they are not broadcast.
    """
    prints = materialize(fingerprints(docs, width, seed), "simhash-prints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    links = shards(reps, radius).repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_links(radius), "u long, v long")
    roots = components(links, "simhash-components")
    linked = roots.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = materialize(linked.union(linked.select("root", "root").distinct()).join(reps, "fp"), "simhash-linked")
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("least")), "simhash-least")
    moved = linked.join(least, "root").select("fp", "root", "least")
    labels = materialize(reps.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("least", "rep").alias("component_id")), "simhash-labels")
    return prints.join(labels, "fp").select("doc_id", "body", "fp", "group", "component_id")


def candidates(prints: DataFrame, radius: int, most: int = 256) -> DataFrame:
    """(a, b): pairs of keys whose fingerprints are within ``radius``, one or a few for each key that has such a neighbour.

    ``prints``: key (long, each once), size, fp. Keys of one fingerprint are
    paired with its least; every fingerprint with the fullest of its
    neighbours in each shard's BK-tree. There are two rounds of splitting.
    """
    reps = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep")), "simhash-reps")
    same = prints.join(reps, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    dealt = shards(reps, radius, most, rounds=2).repartition("shard").sortWithinPartitions("shard")
    near = materialize(dealt.mapInArrow(_shard_links(radius, _chiefs), "u long, v long").distinct(), "simhash-near")
    left, right = reps.select(F.col("fp").alias("u"), F.col("rep").alias("_u")), reps.select(F.col("fp").alias("v"), F.col("rep").alias("_v"))
    near = near.join(left, "u").join(right, "v").select(F.least("_u", "_v").alias("a"), F.greatest("_u", "_v").alias("b"))
    return materialize(same.union(near).distinct(), "simhash-candidates")


def first_of_each(docs: DataFrame, radius: int = RADIUS, width: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, one of each group of near_duplicates()."""
    return keep_first(docs, near_duplicates(docs, radius, width, seed))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group: that of its smallest doc_id, of several texts the one of least hash; of repeated rows one.

    Rows are kept by a semi-join with the chosen ids, which shuffles them once
    unless the ids are few enough to be broadcast; repeated rows are also made
    distinct.
    """
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("body").alias("_body"), F.min("doc_id").alias("_doc"))
    chosen = chosen.groupBy("_doc", "_body").agg(F.count("*").alias("_groups"))
    times = found.groupBy(F.col("doc_id").alias("_doc"), F.col("body").alias("_body")).agg(F.count("*").alias("_times"))
    both = [F.col("c._doc").eqNullSafe(F.col("t._doc")), F.col("c._body") == F.col("t._body")]
    chosen = materialize(chosen.alias("c").join(times.alias("t"), both).select("c._doc", "c._body", "_times"), "simhash-chosen")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), body_hash().alias("_hash"))
    on = [F.col("_id").eqNullSafe(F.col("_doc")), F.col("_hash") == F.col("_body")]
    once = rows.join(chosen.where("_times = 1"), on, "left_semi").select("_row.*")
    again = chosen.where("_times > 1")
    if not again.head(1):
        return once
    repeated = rows.join(again, on, "left_semi").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return once.unionByName(repeated.select("_row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
