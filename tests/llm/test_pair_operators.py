"""SimHash, embeddings, mixing, packing, URLs and shared pieces, each against a plain version."""

import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
import fixtures as X
from oracle import differences

from tallyforge.llm import common, covertree, mixing, packing, simhash, urlfilter
from tallyforge.llm.queries import ORACLES, QUERIES
from tallyforge.llm.tokens import word_bpe

FOLDER = "/root/testdata/sf0.001"


def groups(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_near_duplicates(rows, got):
    fps = [plain_fingerprint(r[1]) for r in rows]
    found = groups(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {g: min((r[0] for r, h in zip(rows, found, strict=True) if h == g and r[0] is not None), default=None) for g in found}
    want = Counter((r[0], f, least[g]) for r, f, g in zip(rows, fps, found, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_simhash(spark):
    rows = [r for r in X.rows() if r[0] != 206]
    docs = X.documents(spark, clash=True).where("doc_id is null or doc_id <> 206")
    check_near_duplicates(rows, simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(X.none(spark)).collect() == []


def test_simhash_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op4_simhash"](spark, FOLDER).select("doc_id", F.conv("fingerprint", 16, -10).cast("long").alias("fp"), "component_id").collect()
    check_near_duplicates(rows, got)


def test_bk_forest_finds_all_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i, j in itertools.combinations(range(0, 60, 7), 2))]))
    shard = (fp % np.uint64(3)).astype(np.int64)
    forest = simhash.BKForest(shard, fp)
    got = {tuple(sorted((int(forest.fp[a]), int(forest.fp[b])))) for x, y in forest.links(2, block=100) for a, b in zip(x, y, strict=True)}
    want = {(int(a), int(b)) for a, b in itertools.combinations(sorted(fp), 2) if a % 3 == b % 3 and int(a ^ b).bit_count() <= 2}
    assert got == want


def test_hot_shards_are_split_without_loss(spark):
    """Fingerprints that share most of their bits, in shards of four at most."""
    rng = random.Random(4)
    fps = sorted({rng.randrange(1 << 9) << rng.choice([0, 20]) for _ in range(150)})
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    pairs = simhash.shards(rows, 2, most=4)
    meet = pairs.alias("a").join(pairs.alias("b"), F.col("a.shard") == F.col("b.shard")).select("a.fp", F.col("b.fp").alias("o")).where("fp < o").distinct().collect()
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    assert want <= {(r["fp"], r["o"]) for r in meet}


def test_first_of_each(spark):
    docs = X.documents(spark, clash=True).where("doc_id is null or doc_id <> 206")
    got = simhash.first_of_each(docs)
    assert got.columns == docs.columns
    found = simhash.near_duplicates(docs)
    kept, n_groups = [r["doc_id"] for r in got.collect()], found.select("group").distinct().count()
    assert len(kept) == n_groups and Counter(kept)[208] <= 1
    assert sorted(x for x in kept if x is not None) == sorted(x for x in {r["component_id"] for r in found.collect()} if x is not None)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["u"]: r["v"] for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    found = groups(len(nodes), [(at[a], at[b]) for a, b in edges])
    least = {}
    for x, g in zip(nodes, found, strict=True):
        least.setdefault(g, x)
    assert got == {x: least[g] for x, g in zip(nodes, found, strict=True) if least[g] != x}
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_links(rows, least=0.98):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links.append((i, j))
    n = Counter(x for e in links for x in e)
    found = groups(len(rows), links)
    small = {}
    for (i, _, _), g in zip(rows, found, strict=True):
        small[g] = min(small.get(g, 1 << 60), i)
    return Counter((r[0], n[i], small[g]) for i, (r, g) in enumerate(zip(rows, found, strict=True)))


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        centre = rng.normal(size=8)
        rows += [(100 * c + i, (centre + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.4])).astype(np.float32).tolist(), c % 2) for i in range(25)]
    same = rows[0][1]
    rows += [(1000 + i, same, 0) for i in range(4)] + [(1010, [2 * x for x in same], 0), (1011, same, 1), (1012, same, None), (1013, None, 0), (1014, [0.0] * 8, 0), (1015, [float("nan")] + [1.0] * 7, 0), (1016, [float("inf")] * 8, 0), (1017, [None, 1.0], 0), (1018, [], 0), (1019, [1.0, 0.0], 0), (1020, [1.0, 0.0], 0), (1020, [1.0, 0.0], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_embeddings(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("vec", "cell", "own", "weight", "cid", "n")))
    tell = lambda got: Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert tell(covertree.linked(df).collect()) == plain_links(rows)
    # the same with tiny cells, so that the upper levels split and send visitors
    monkeypatch.setattr(covertree, "CELL", 12)
    monkeypatch.setattr(covertree, "VISITORS", 10)
    split = covertree._split
    monkeypatch.setattr(covertree, "_split", lambda r, least: split(r, least, 12))
    got = covertree.linked(df).collect()
    assert tell(got) == plain_links(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert covertree.linked(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors_of_any_size(spark):
    """Components near the ends of double precision, beside ordinary ones of the label."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) * 0.01 + [1, 2, 3, 4]).tolist(), 0) for i in range(8)]
    rows += [(20, [1e300, 0.0, 0.0, 0.0], 0), (21, [1e-300, 0.0, 0.0, 0.0], 0), (22, [1.7e308] * 4, 0), (23, [5e-324] * 4, 0), (24, [1e300, 2e300, 3e300, 4e300], 0), (25, [1.0, 1.0, 1.0, 1.0 + 1e-9], 0)]
    got = covertree.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)


def test_op10_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = QUERIES["op10_embeddings"](spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)



def test_cover_tree_covers_and_finds_all():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:80] = x[:30]
    tree = covertree.CoverTree(x, leaf=4)
    for c, r, members, kids in zip(tree.centre, tree.radius, tree.members, tree.children, strict=True):
        assert covertree.chord(x[members], x[[c]]).max() <= r + 1e-7
        assert kids is None or sorted(np.concatenate([tree.members[k] for k in kids])) == sorted(members)
    least = 0.98
    n, label = covertree.links_in_cell(x[:200], np.ones(200, np.int64), x[200:], np.ones(100, np.int64), least, True)
    cos = x @ x.T
    near = (cos >= least) & ~np.eye(300, dtype=bool)
    near[200:, 200:] = False
    assert (n == near.sum(axis=1)).all()
    found = groups(300, list(zip(*np.nonzero(near), strict=True)))
    assert len(set(zip(found, label.tolist(), strict=True))) == len(set(found)) == len(set(label.tolist()))


def test_mixing_is_the_sql(spark):
    assert differences(QUERIES["op6_mixing"](spark, FOLDER), ORACLES["op6_mixing"], FOLDER) == ""


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, free, left, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), sum(sizes.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(spark):
    docs = X.documents(spark, clash=True)
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], size(r[1])) for r in X.rows())
    sizes = Counter()
    for r in X.rows():
        sizes[r[3]] += size(r[1])
    want = plain_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    assert Counter(r["doc_id"] for r in mixing.copies(docs).collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in got if r["size"] and r["copies"]), Counter())
    assert mixing.copies(docs).columns == docs.columns and mixing.mix(X.none(spark)).collect() == [] and mixing.copies(X.none(spark)).collect() == []
    assert [tuple(r) for r in mixing.mix(docs).orderBy("doc_id", "size").collect()] == [tuple(r) for r in mixing.mix(docs).orderBy("doc_id", "size").collect()]


def test_mixing_uses_no_python(spark):
    plan = mixing.mix(X.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def fewest(items, capacity):
    """The fewest sequences, by trying all."""
    best = len(items)
    items = sorted(items, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            k = rooms.index(room)
            place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    items = [rng.randint(max(1, capacity // rng.choice([3, 4, 6])), capacity) for _ in range(rng.randint(1, 9))]
    fixed, rest = packing.reduce(Counter(items), capacity)
    assert Counter(x for bins, times in fixed for x in bins * times) + Counter(rest) == Counter(items) and all(sum(b) <= capacity for b, _ in fixed)
    assert sum(t for _, t in fixed) + fewest(list(Counter(rest).elements()), capacity) == fewest(items, capacity)
    plan = packing.plan(Counter(items), capacity)
    assert Counter(x for bins, times in plan for x in bins * times) == Counter(items) and all(sum(b) <= capacity for b, _ in plan)


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(9)
    items = sorted((rng.randint(1, 60) for _ in range(500)), reverse=True)
    rooms = []
    for x in items:
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(100 - x)
        else:
            rooms[rooms.index(fit)] -= x
    assert sum(t for _, t in packing.best_fit(Counter(items), 100)) == len(rooms)


def check_packing(rows, got):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(word_bpe()), Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= max(-(-total // 2048) * 1.05 + 1, 1)


def test_packing(spark):
    docs = X.documents(spark, clash=True)
    check_packing([(r[0], r[1]) for r in X.rows()], packing.packed_documents(docs, word_bpe()).collect())
    assert packing.packed_documents(X.none(spark), word_bpe()).collect() == []


def test_packing_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check_packing(rows, QUERIES["op7_packing"](spark, FOLDER).collect())


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]


def plain_rule(host, path):
    fits = [g for g in urlfilter.GIVEN if (host == g.host or host.endswith("." + g.host)) and path.startswith(g.path)]
    best = max(fits, key=lambda g: len(g.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


URLS = ["http://A.Example.COM/en/7x?q", "https://example.com/en/8", "ftp://x.net/de/", "http://example.net/de/80", "http://notexample.net/de/8", "http://org/es/a#b", "no scheme.com/en/", "://com/en/x://y", None, "", "http://", "http://com", "http://com?x=/en/", "http://É.com/en/a\nb", "http://a.com./en/", "http://.com/en/", "http://com/EN/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i % 15, u) for i, u in enumerate(URLS)], "page_id long, url string").select("*", *(F.lit(1).alias(c) for c in ("host", "path", "given", "mined", "bad")))
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = urlfilter.judged(pages, labels).collect()
    want = Counter()
    for i, u in enumerate(URLS):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        want[i % 15, host, path, rule, verdict or "allow"] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert urlfilter.judged(pages.limit(0), labels).collect() == []


def test_url_rules_are_mined(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        host, word = rng.choice(["a", "spam", "b", "c"]), rng.choice(["win", "news", "doc"])
        rows.append((f"http://{host}.fr/{word}/{i}", host == "spam" and word == "win" if rng.random() > 0.03 else False))
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {"h:spam", "p:win"} in [set(t) for t, _, _ in rules] and all(c >= urlfilter.CONFIDENCE for _, c, _ in rules)
    tokens = spark.createDataFrame([("http://x.spam.fr/q/win",), ("http://spam.fr/news",)], "url string").select(urlfilter.matched(urlfilter.url_tokens(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))), rules).alias("m"))
    assert [r["m"] for r in tokens.collect()] == [True, False]


def plain_rules(rows, least, most_tokens=4):
    """Rules by counting every set of tokens of every URL."""
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    times, bad = Counter(), Counter()
    for url, b in rows:
        host, path = plain_url(url)
        words = re.split("[^a-z#\\x80-\\U0010ffff]+", re.sub("[0-9]+", "#", path.lower()))
        tokens = sorted({f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in words if x})
        for k in range(1, most_tokens + 1):
            for t in itertools.combinations(tokens, k):
                times[t] += 1
                bad[t] += b
    often = [t for t in times if times[t] >= max(least, -(-urlfilter.SUPPORT * n // 1))]
    floor = max(urlfilter.CONFIDENCE, min(urlfilter.LIFT * base, (1 + base) / 2))
    good = {}
    for t in often:
        share = bad[t] / times[t]
        if share >= floor and share > base:
            odds = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)
            if len(often) * math.exp(-times[t] * odds) <= urlfilter.CHANCE:
                good[t] = share
    return {t for t, c in good.items() if not any(set(u) < set(t) and d >= c for u, d in good.items())}


def test_mined_rules_are_those_of_all_sets(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        host, top, word, ext = rng.choice(["shop", "spam", "b", "c", "d"]), rng.choice(["com", "net"]), rng.choice(["win", "news", "doc", "x"]), rng.choice(["html", "php", ""])
        likely = 0.9 if (host, word) == ("spam", "win") else 0.7 if (top, word, ext) == ("net", "x", "php") else 0.15
        rows.append((f"https://{host}.{top}/{word}/{i}.{ext}", rng.random() < likely))
    want = plain_rules(rows, urlfilter.LEAST_URLS)
    got = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {tuple(sorted(t)) for t, _, _ in got} == want and len(want) > 1
    # verdicts of pages without a given rule follow the rules
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    hit = 0
    for r in urlfilter.judged(pages, labels, given=()).collect():
        tokens = {f"h:{x}" for x in r["host"].split(".")} | {f"p:{x}" for x in re.split("[^a-z#]+", re.sub("[0-9]+", "#", r["path"].lower())) if x}
        mined = any(set(t) <= tokens for t in want)
        assert (r["mined"], r["verdict"]) == (mined, "block" if mined else "allow")
        hit += mined
    assert hit > 20
    # labels that say nothing give no rule
    assert urlfilter.mine(spark.createDataFrame([(u, rng.random() < 0.25) for u, _ in rows], "url string, bad boolean")) == []


def test_url_query(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op8_urls"](spark, FOLDER).collect():
        host, path = plain_url(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
