"""The near-duplicate stage against the Jaccard similarity of all pairs."""

import itertools
import random
import sys
from collections import Counter
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]
import corpus_pipeline as P
import fixtures as X
from pyspark.sql import functions as F
from test_pair_operators import groups

from tallyforge.llm import neardup
from tallyforge.llm.simhash import candidates

FOLDER = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_first(rows):
    """The smallest doc_id of each group."""
    sets = [plain_shingles(t) for _, t in rows]
    linked = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    found, least = groups(len(rows), linked), {}
    for (i, _), g in zip(rows, found, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    return Counter(least.values()), linked


def edited(text, r, n):
    words = text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_stage_is_that_of_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, t) for i, t, *_ in X.rows() if i != 206]
    for k in range(12):  # from nearly equal to a little under 0.8
        base = X.prose(500 + k, 200)
        rows += [(1000 + 10 * k + n, edited(base, r, n)) for n in range(6)]
    chain = X.prose(900, 120).split()
    rows += [(2000 + k, " ".join(chain[3 * k : 3 * k + 60])) for k in range(12)]  # each like the next, the ends not alike
    hot = X.prose(901, 150)
    rows += [(3000 + k, edited(hot, r, 1 + k % 2)) for k in range(60)]
    want, linked = plain_first(rows)
    assert len(linked) > 300
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], X.DOCUMENT).repartition(4)
    got = P.near_duplicates(spark, docs, FOLDER)
    assert got.columns == docs.columns and Counter(x["doc_id"] for x in got.collect()) == want


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want, _ = plain_first([(x["doc_id"], x["text"]) for x in docs.collect()])
    assert Counter(x["doc_id"] for x in P.near_duplicates(spark, docs, FOLDER).collect()) == want


def test_a_bucket_of_unlike_texts_loses_no_pair(spark):
    r = random.Random(5)
    rows = [(10 * k + n, edited(X.prose(k, 100), r, n)) for k in range(12) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    prints = neardup.sketches(docs).withColumn("bands", F.array(F.lit(1).cast("long")))
    reps = prints.select("key", "size", "bands", F.struct(F.lit(False).alias("_none"), "doc_id", "body").alias("least"))
    roots = {x["u"]: x["v"] for x in neardup.links(docs, reps).collect()}
    keys = {x["doc_id"]: roots.get(x["key"], x["key"]) for x in prints.collect()}
    linked = plain_first(rows)[1]
    found = groups(len(rows), linked)
    assert len(set(keys.values())) == len(set(found)) and all(keys[rows[a][0]] == keys[rows[b][0]] for a, b in linked)


def test_bk_trees_over_simhashes_find_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RADIUS", 7)  # wide enough for a group of many links
    r = random.Random(11)
    rows = [(10 * k + n, edited(X.prose(700 + k, 200), r, n)) for k in range(12) for n in range(3)] + [(5000 + k, edited(X.prose(950, 200), r, 1)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {x["key"]: x for x in neardup.sketches(docs).collect()}
    apart = lambda a, b: ((prints[a]["fp"] ^ prints[b]["fp"]) & (2**64 - 1)).bit_count()
    near = {frozenset((a, b)) for a, b in itertools.combinations(prints, 2) if apart(a, b) <= neardup.RADIUS}
    table = spark.createDataFrame([(k, x["size"], x["fp"]) for k, x in prints.items()], "key long, size long, fp long")
    for most in (1024, 8):
        found = {frozenset((x["a"], x["b"])) for x in candidates(table, neardup.RADIUS, most).collect()}
        assert found <= near
    # every text that has a neighbour within the radius has a pair, and a large group not all of its pairs
    whole = {frozenset((x["a"], x["b"])) for x in candidates(table, neardup.RADIUS).collect()}
    assert {k for p in whole for k in p} == {k for p in near for k in p} and len(whole) < len(near) / 2
    reps = neardup.sketches(docs).select("key", "size", "fp", "bands", F.struct(F.lit(False).alias("_none"), "doc_id", "body").alias("least"))
    links = [(x["u"], x["v"]) for x in neardup.near_links(docs, reps).collect()]
    similar = {frozenset((a, b)) for a, b in ((rows[i][0], rows[j][0]) for i, j in plain_first(rows)[1])}
    ids = {k: x["doc_id"] for k, x in prints.items()}
    assert len(links) > 30 and all(frozenset((ids[u], ids[v])) in similar for u, v in links)
