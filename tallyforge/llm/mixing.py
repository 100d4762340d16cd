"""Mixing sources to target weights by nested hash thresholds; DataFrame and SQL operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialize, table

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Hash bits of one histogram, and how many are nested.
BITS, LEVELS = 12, 3
#: Sources whose few columns are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))


def _hash() -> Column:
    """60 bits of the MD5 of doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (source, never null), size in words, and hash."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", _key().alias("key"), size.alias("size"), _hash().alias("hash"))


def _running(df: DataFrame, order: Column, sums: list[str]) -> DataFrame:
    """``df`` with rank (from 1 in ``order``) and, for each of ``sums``, before_ and its sum over the rows before.

    Rows are dealt by ranges and summed range by range; the only window
    without a key is over one row per range.
    """
    zero = F.lit(0).cast("long")
    dealt = df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    rows = materialize(dealt, "mixing-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{c}") for c in sums))
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(before), zero).alias("_n"), *(F.coalesce(F.sum(f"_{c}").over(before), zero).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy("_range").orderBy("_at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"_rank": F.row_number().over(inside), **{f"_in_{c}": F.coalesce(F.sum(c).over(earlier), zero) for c in sums}}).join(starts, "_range")
    return out.select(*df.columns, (F.col("_n") + F.col("_rank")).alias("rank"), *((F.col(f"_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """source, key, source_size, target, times, rest: one row per source.

    Sources by code point, null last, have the weights in turn and share all
    words by them. A target stops at ``most`` times its source's size; the
    excess goes to the others by weight. Taken in the order of size by weight,
    a source stops if its share of what those before it leave is above its
    limit. times and rest: whole copies of the source in its target, and the
    words beyond, rounded. No document gives no source.
    """
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    # keys are "n" for null and "s" with the source else, so null is put last by itself
    placed = _running(sources, F.col("source").asc_nulls_last(), [])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.withColumn("weight", w.cast("long")).withColumn("cap", most * F.col("source_size")).drop("rank")
    order = F.struct((F.col("cap") / F.col("weight")).alias("r"), "key").asc()
    ranked = materialize(_running(weighed, order, ["cap", "weight"]), "mixing-ranked")
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, open_ = F.lit(total) - F.col("before_cap"), F.lit(weight) - F.col("before_weight")
    ranked = ranked.withColumn("stops", left.cast("double") * F.col("weight") / open_ > F.col("cap"))
    free = ranked.where("not stops").agg(F.min(F.struct("rank", "before_cap", "before_weight")).alias("f")).select("f.*").first()
    used, gone = (free["before_cap"], free["before_weight"]) if free["rank"] is not None else (0, 0)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.lit(total - used).cast("double") * F.col("weight") / F.lit(weight - gone))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = ranked.withColumn("target", target).withColumn("times", times)
    return out.select("key", "source_size", "target", "times", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long").alias("rest"))


def _small(goals: DataFrame):
    """Broadcasts a table of a row per source if it has few rows."""
    return F.broadcast if goals.count() <= BROADCAST_SOURCES else lambda df: df


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """key, source_size, target, times and under, for each source of the ``sized`` rows.

    A document is in the mix ``times`` times, and once more if the first 36
    bits of its hash are less than ``under`` (null: none). That comes from
    nested histograms: words by source and hash bucket, then only those of the
    bucket in which the rest runs out, and so on; the last bucket is taken if
    that is nearer. Nothing is sorted but the buckets of a source.
    """
    goals = materialize(targets(rows, weights, most), "mixing-goals")
    small = _small(goals)
    edge = goals.where("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = rows.select("key", "size", "hash").join(small(edge), "key").where(F.shiftright("hash", 60 - BITS * level) == F.col("prefix"))
        bucket = F.shiftright("hash", 60 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)
        words = inside.groupBy("key", "rest", "prefix", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        run_out = words.withColumn("before", before).where("before < rest and rest <= before + words")
        last = materialize(run_out.select("key", (F.col("rest") - F.col("before")).alias("rest"), (F.col("prefix") * (1 << BITS) + F.col("bucket")).alias("prefix"), "words"), "mixing-edge")
        edge = last.select("key", "rest", "prefix")
    last = last.select("key", (F.col("prefix") + F.when(2 * F.col("rest") >= F.col("words"), 1).otherwise(0)).alias("under"))
    return materialize(goals.join(last, "key", "left").drop("rest"), "mixing-thresholds")


def _copies(hash_: Column) -> Column:
    return F.col("times") + F.coalesce((F.shiftright(hash_, 60 - BITS * LEVELS) < F.col("under")).cast("long"), F.lit(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    The taken words of a source miss its target by half of the words of one
    36-bit hash at most. Null texts and texts without words have size 0 and
    take 0; a null source is a source, and a null doc_id hashes as an empty
    one; texts of any length are counted whole; rows of one doc_id share a hash
    and go together; no document gives no row; other columns are ignored.
    Reruns agree.
    """
    rows = materialize(sized(docs), "mixing-sizes")
    goals = thresholds(rows, weights, most)
    out = rows.join(_small(goals)(goals), "key").withColumn("copies", _copies(F.col("hash")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; those without words are left out."""
    rows = materialize(sized(docs), "mixing-sizes")
    goals = thresholds(rows, weights, most).withColumnRenamed("key", "_key")
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.struct("*").alias("_row"), _key().alias("_key"), _hash().alias("_hash"))
    out = worded.join(_small(goals)(goals), "_key").withColumn("_copies", _copies(F.col("_hash"))).where("_copies > 0")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS prefix
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
r AS (SELECT *, row_number() OVER o AS rank,
        (sum(source_size) OVER ())::BIGINT AS total,
        coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
        (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
      FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source ASC NULLS FIRST)),
s AS (SELECT *, (total - used)::DOUBLE * weight::DOUBLE / open::DOUBLE > 3 * source_size AS stops FROM r),
f AS (SELECT used AS free_used, open AS free_open FROM s WHERE NOT stops ORDER BY rank LIMIT 1),
t AS (SELECT s.*, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (total - free_used)::DOUBLE * weight::DOUBLE / free_open::DOUBLE END AS target FROM s LEFT JOIN f ON true),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
g2 AS (SELECT *, round(target - times * source_size)::BIGINT AS rest FROM g),
p AS (SELECT source, prefix, sum(size)::BIGINT AS words FROM sized GROUP BY source, prefix),
q AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p),
x AS (SELECT q.source, q.prefix, (before + words < rest OR (before < rest AND rest <= before + words AND 2 * (rest - before) >= words)) AS extra
      FROM q JOIN g2 ON q.source IS NOT DISTINCT FROM g2.source)
SELECT d.doc_id, d.size, g2.source_size, g2.target, d.size * (g2.times + CASE WHEN x.extra THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN g2 ON d.source IS NOT DISTINCT FROM g2.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.prefix = x.prefix
"""
