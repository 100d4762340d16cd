"""A ledger whose rows are current by one rule and stale by another."""

from tallyforge.llm import secretscan as S


def test_spans_of_a_stale_rule_are_not_found(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    one, two = S.RULES[0], S.RULES[1]
    rows = docs.select(S.blob_id(docs["text"]).alias("blob")).collect()
    spans = [{"kind": one.name, "start": 0, "end": 1}, {"kind": two.name, "start": 2, "end": 3}]
    ledger = spark.createDataFrame([(rows[0]["blob"], [one.key, f"{two.name}@stale"], spans)], f"blob binary, rules array<string>, spans {S.SPANS}")
    got = S.findings(docs, ledger, ["doc_id"]).collect()
    assert [[tuple(s) for s in r["spans"]] for r in got] == [[(one.name, 0, 1)]]


def test_a_kept_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "password = hunter22x"), (2, "nothing"), (3, None), (4, "nothing")], schema)
    plain = lambda df: sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in df.collect())
    first = S.kept_ledger(docs, path)
    assert first.count() == 3  # copies are one blob
    assert S.scan(docs, first).count() == 0
    again = S.kept_ledger(docs, path)
    assert again.count() == 3 and plain(S.findings(docs, again, ["doc_id"])) == plain(S.scanned(docs))
    more = docs.union(spark.createDataFrame([(5, "token: abcdef123")], schema))
    assert S.scan(more, again).count() == 1
    grown = S.kept_ledger(more, path)
    assert grown.count() == 4 and plain(S.findings(more, grown, ["doc_id"])) == plain(S.scanned(more))
    newer = (S.Rule(S.RULES[0].name, S.RULES[0].version + 1, S.RULES[0].pattern, S.RULES[0].least, S.RULES[0].group, S.RULES[0].hints), *S.RULES[1:])
    due = S.scan(more, grown, newer).collect()
    assert len(due) == 4 and {tuple(r["rules"]) for r in due} == {(newer[0].key,)}


def test_the_query_keeps_its_ledger_where_it_is_told(spark, tmp_path):
    from tallyforge.llm.queries import QUERIES

    folder, path = "/root/testdata/sf0.001", str(tmp_path / "ledger")
    want = sorted(map(tuple, QUERIES["op9_secrets"](spark, folder).collect()))
    spark.conf.set(S.LEDGER_SETTING, path)
    try:
        for _ in range(2):
            assert sorted(map(tuple, QUERIES["op9_secrets"](spark, folder).collect())) == want
        n = spark.read.parquet(path)
        assert n.count() == n.select("blob").distinct().count()
    finally:
        spark.conf.unset(S.LEDGER_SETTING)
