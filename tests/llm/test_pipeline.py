"""The pipeline's stages against plain versions, and run() against the stages in turn."""

import sys
from collections import Counter
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]
import corpus_pipeline as P
import fixtures as X
from test_neardup import plain_first
from test_pair_operators import check_packing
from test_text_operators import SECRETS, plain_statistics

FOLDER = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(SECRETS) for m in p.finditer(text) if ok(m))
    out, at = "", 0
    for a, _, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        results.append(docs.collect())
        assert i == 4 or docs.columns == columns
    before = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    good, first, clean, mixed, packed = results
    for r in good:
        n, _, _, _, repeated = plain_statistics(r["text"])
        assert n >= 10 and 100 * repeated <= 20 * n and r == before[r["doc_id"]]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert sum(labels[i] == 1 for i in kept if i in labels) > 0.9 * sum(x == 1 for x in labels.values())
    assert Counter(r["doc_id"] for r in first) == plain_first([(r["doc_id"], r["text"]) for r in good])[0]
    assert {r["doc_id"]: r["text"] for r in clean} == {r["doc_id"]: redacted(r["text"]) for r in first}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] != before[r["doc_id"]]["text"] else before[r["doc_id"]]["n_chars"]) for r in clean)
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in clean} and max(times.values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in clean}
    check_packing([(r["doc_id"], texts[r["doc_id"]]) for r in mixed], packed)
    whole = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, FOLDER).collect())
    assert whole == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_take_odd_rows(spark):
    for clash in (False, True):
        docs = X.documents(spark, clash)
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, FOLDER)
            assert out.collect() and (i == 4 or out.columns == docs.columns)
    for _, stage in P.STAGES:
        assert stage(spark, X.none(spark), FOLDER).collect() == []
