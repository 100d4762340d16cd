"""Packing documents into sequences: dominance reduction, then best fit, on the histogram of piece lengths.

Pieces of one length are alike, so the packing is worked out on at most
``capacity`` counts, whatever the number of documents, and is the packing of
all pieces together. Pieces then take their places by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_rows, materialize, small_batches, table, text_bytes
from tallyforge.llm.tokens import packed, word_bpe, word_cache

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end``, cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tail = word_cache(tokenizer, packed), packed([end])
        for batch in arrow_rows(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = cache.ids(text) + tail
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts of lengths, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect_left(self.order, length))

    def largest_up_to(self, length: int, without: int = -1) -> int:
        """The largest length left that is at most ``length``, not counting one piece of ``without``; 0 if none."""
        i = bisect_left(self.order, length + 1) - 1
        if i >= 0 and self.order[i] == without and self.n[without] < 2:
            i -= 1
        return self.order[i] if i >= 0 else 0


def _dominant(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set with j that dominates all others that hold j, if one of three pieces at most does.

    A set dominates another if the other's pieces can be shared out among its
    pieces without any share being larger than the piece it goes to; then some
    best packing holds it.
    """
    room = capacity - j
    small = [x for x in stock.order[:4] for _ in range(min(3, stock.n[x] - (x == j)))][:3]
    if not small or small[0] > room:
        return (j,)
    top = stock.largest_up_to(room, j)
    if top == room or len(small) < 2 or small[0] + small[1] > room:
        return (j, top)  # it fills the room, or nothing fits beside one more
    if len(small) > 2 and sum(small) <= room:
        return None
    best, second = 0, 0  # pairs r >= s that fit: the largest sum, the largest s
    for r in stock.order:
        if r > room - small[0]:
            break
        if r == j and stock.n[j] < 2:
            continue
        stock.n[r] -= 1
        s = stock.largest_up_to(min(room - r, r), j)
        if s == r and stock.n[r] - (r == j) < 1:
            s = stock.largest_up_to(min(room - r, r - 1), j)
        if s:
            best, second = max(best, r + s), max(second, s)
        stock.n[r] += 1
    if best <= top:
        return (j, top)
    left = stock.largest_up_to(min(room - top, top), j)
    if left and left >= second and (left != top or stock.n[top] - (top == j) >= 2):
        return (j, top, left)
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences (lengths, times) fixed for good by dominance, and the counts that remain."""
    stock, fixed = _Stock(counts), []
    again = True
    while again:
        again = False
        for j in sorted(stock.n, reverse=True):
            while j in stock.n:
                found = _dominant(stock, j, capacity)
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                # as often as the pieces allow: with fewer pieces left the set still dominates
                times = min(stock.n[x] // k for x, k in need.items())
                for x, k in need.items():
                    stock.take(x, k * times)
                fixed.append((found, times))
                again = True
    return fixed, stock.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit from the longest down, on runs of alike sequences: (lengths, times)."""
    rooms: list[int] = []  # in order
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(bins: tuple[int, ...], times: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((bins, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = min(capacity // length, left)
                times = left // each
                put((length,) * each, times, capacity - each * length)
                left -= each * times
                continue
            room = rooms[i]
            bins, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            each = min(room // length, left)
            used = min(times, left // each)
            put(bins + (length,) * each, used, room - each * length)
            if times > used:
                put(bins, times - used, room)
            left -= each * used
    return [x for room in sorted(by_room) for x in by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, times) that hold every piece once."""
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, times, first sequence, offset): ranks of a length that lie at one offset of alike sequences."""
    out, rank, sequence = [], {}, 0
    for lengths, times in sequences:
        offset = 0
        for x in lengths:
            first = rank.get(x, 0)
            out.append((x, first, times, sequence, offset))
            rank[x] = first + times
            offset += x
        sequence += times
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, parts: int = 1 << 16) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset.

    Ranks within a length come from about ``parts`` hash blocks over all
    lengths: each block is ranked by itself and begins where those before it
    end, so a length that a third of all rows have is ranked by many tasks.
    """
    spark = found.sparkSession
    found = materialize(found, "packing-pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(counts.values())
    each = max(128, -(-total // parts))
    blocks = spark.createDataFrame([(k, -(-n // each)) for k, n in counts.items()], "length long, blocks long")
    rows = found.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "blocks")).drop("blocks")
    sizes = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = materialize(sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins")), "packing-begins")
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = rows.withColumn("in_block", F.row_number().over(inside) - 1)
    if total and begins.count() <= 1 << 18:
        begins = F.broadcast(begins)
    ranked = ranked.join(begins, ["length", "block"]).withColumn("rank", F.col("begins") + F.col("in_block"))
    # For each length the first ranks of its runs in order, and what belongs to each. Their number follows capacity, not the rows.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in slots(plan(counts, capacity)):
        runs.setdefault(length, []).append((first, sequence, offset))
    table_rows = [(k, i // 64, [x[0] for x in part], [x[1] for x in part], [x[2] for x in part]) for k, v in runs.items() for i in range(0, len(v), 64) for part in [v[i : i + 64]]]
    lows: dict[int, list[int]] = {}
    for k, _, firsts, _, _ in table_rows:
        lows.setdefault(k, []).append(firsts[0])
    places = spark.createDataFrame(table_rows, "length long, page long, firsts array<long>, sequences array<long>, offsets array<long>")
    pages = spark.createDataFrame(list(lows.items()), "length long, lows array<long>")
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("rank"))) - 1
    placed = ranked.join(F.broadcast(pages), "length").withColumn("page", upto(F.col("lows")).cast("long")).join(F.broadcast(places), ["length", "page"]).withColumn("i", upto(F.col("firsts")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.get("sequences", F.col("i")) + F.col("rank") - F.get("firsts", F.col("i"))).alias("sequence_id"), F.get("offsets", F.col("i")).alias("offset")
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the closing id alone. Only texts of
    over ``capacity`` ids are cut. Repeated rows are packed each by itself; of
    rows alike in doc_id, piece and ids any may take either place. No document
    gives no row; extra columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), word_bpe())
