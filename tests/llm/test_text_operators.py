"""Token counts, quality rules, language, personal data and secrets, each against a plain version."""

import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as X

from tallyforge.llm import langid, pii, quality, secretscan, tokens
from tallyforge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe()).encode(text or "", add_special_tokens=False).ids


def test_word_cache_gives_the_tokenizers_ids():
    cache = tokens.WordCache(tokens.word_bpe(), tokens.packed, most=50)
    texts = [r[1] for r in X.rows()] + ["Don't l'eau İSTANBUL ſ á ²³ x2y <|endoftext|> <|ENDOFTEXT|> (foo)bar é!? 'S ..' --a", "\x1c\x85a　b"]
    for text in texts:
        if len(text or "") < 20_000:
            got = np.frombuffer(cache.ids((text or "").encode()), "<u4").tolist()
            assert got == reference_ids(text), text


def test_token_histogram(spark):
    docs = X.documents(spark, clash=True).where("doc_id is null or doc_id not in (205, 206)")
    lengths = sorted(len(reference_ids(r[1])) for r in X.rows() if r[0] not in (205, 206))
    got = {r["n_tokens"]: r for r in tokens.length_histogram(tokens.token_counts(docs, tokens.word_bpe())).collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert r["docs_longer"] == sum(x > k for x in lengths) and r["tokens_longer"] == sum(x for x in lengths if x > k)
        assert r["tokens_truncated"] == sum(min(x, k) for x in lengths) and r["tokens_within"] == sum(x for x in lengths if x <= k)
        assert r["quantile"] == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    one = tokens.at_limit(tokens.length_histogram(tokens.token_counts(docs, tokens.word_bpe())), 100).first()
    assert one["tokens_truncated"] == sum(min(x, 100) for x in lengths)
    assert tokens.length_histogram(tokens.token_counts(X.none(spark), tokens.word_bpe())).collect() == []


def plain_statistics(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_and_base_rule(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(X.documents(spark, clash=True), labels).collect()
    want = Counter((r[0], *plain_statistics(r[1])) for r in X.rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"] and r["rule"] is None)
    assert quality.judged(X.none(spark), labels).collect() == []
    assert quality.good_documents(X.documents(spark, clash=True), labels).columns == X.documents(spark, clash=True).columns


def test_quality_rules_are_learned(spark):
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 2] < 0.5)
    rules = quality.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= r.matches(x, ["a", "b", "c"])
    assert (hit & ~bad).sum() <= 2 and hit[bad].mean() > 0.95
    assert quality.learn(x, np.zeros(900, bool), ["a", "b", "c"]) == [] and quality.learn(np.empty((0, 3)), np.empty(0, bool), ["a", "b", "c"]) == []


def test_quality_on_held_out_labels(spark):
    """Learned from all labels but those of doc_ids divisible by 4, and judged on these."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0 and quality is not null"), "doc_id").select("kept", "quality").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_language_held_out(spark):
    got = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_cases_and_spans(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then it runs away with others", "le renard brun saute par dessus le chien paresseux et puis il court avec les autres"
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr"), ("быстрая лиса прыгает через ленивую собаку", "ru")] * 10)]
    model = langid.train(spark.createDataFrame(rows, X.DOCUMENT))
    cases = [(0, en + " " + fr, None, None, None), (1, None, None, None, None), (2, "", None, None, None), (3, "12 34 !?", None, None, None), (4, "ленивую", None, None, None), (5, "日本", None, None, None), (5, "日本", None, None, None)]
    got = langid.identify(spark.createDataFrame(cases, X.DOCUMENT), model).orderBy("doc_id").collect()
    assert [(s["lang"]) for s in got[0]["spans"]] == ["en", "fr"] and abs(got[0]["spans"][0]["end"] - 16) <= 1
    assert [(r["lang_pred"], r["score"]) for r in got[1:4]] == [("und", 0.0)] * 3 and got[4]["lang_pred"] == "ru" and got[5]["lang_pred"] == got[6]["lang_pred"]
    assert langid.identify(X.none(spark), model).collect() == []
    nothing = langid.train(X.none(spark))
    assert {r["lang_pred"] for r in langid.identify(X.documents(spark, clash=True), nothing).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than a byte holds, each with words of its own."""
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{x}" for x in ("qala", "zento", "wurim", "pexi", "vodu") * 8), f"l{i:03}", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, X.DOCUMENT)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {r[0]: r[2] for r in rows}


def test_a_script_that_nothing_was_learned_of(spark):
    rows = [(i, X.prose(i, 40), "en", "s", 0) for i in range(4)] + [(i, "le chat noir dort sur la table verte " * 3, "fr", "s", 0) for i in range(4, 6)]
    model = langid.train(spark.createDataFrame(rows, X.DOCUMENT))
    cases = [(1, "привет как дела", None, None, 0), (2, "привет the of and", None, None, 0)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(cases, X.DOCUMENT), model).collect()}
    assert (got[1]["lang_pred"], got[1]["score"]) == ("en", 0.0)
    assert got[2]["lang_pred"] == "en" and got[2]["score"] == pytest.approx(8 / 14)


def test_word_scores_are_sums_of_grams(spark):
    """Blocks that cut words give the same sums as whole words."""
    rows = [(i, X.prose(i, 60) + " été Straße αβγ", "en" if i % 2 else "de", "s", 0) for i in range(6)]
    model = langid.train(spark.createDataFrame(rows, X.DOCUMENT))
    words = ["the", "straße", "αβγ", "x", "été" * 9, "a" * 50, "b"]
    whole, kept = model.scores(words), langid._BLOCK
    try:
        langid._BLOCK = 7
        cut = model.scores(words)
    finally:
        langid._BLOCK = kept
    assert np.allclose(whole[0], cut[0], atol=1e-4) and (whole[1] == cut[1]).all()


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(3)
    scores = rng.normal(size=(20, 3)).astype(np.float32)
    lengths = np.array([6, 4, 1, 0])
    ids = rng.integers(0, 20, lengths.sum())
    path, at = langid.viterbi(ids, lengths, scores, 1.0), 0
    for n in lengths:
        own = ids[at : at + n]
        worth = lambda p, own=own: sum(scores[w, x] for w, x in zip(own, p, strict=True)) - sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            assert worth(list(path[at : at + n])) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=int(n)))), abs=1e-4)
        at += n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


only_digits = lambda m: re.sub("[^0-9]", "", m)
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only_digits(m)) <= 15),
}
PII_TEXTS = [
    "a@b.c+x@d.e", "a@b.c@d.e f@g", "x.y%z@h-i.j.k. é q@w.e", "1.2.3.4.5.6.7.8 001.02.3.255 1.2.3.256 1..2.3.4 9" + "9" * 40 + ".1.1.1", "4111 1111-1111 1111 4111-1111-1111-1112 5", "1 " * 20_000, "+1 (668) 555-2041 +49..... +123 +1234567 8+9", "4111111111111111.5", None, "", "@", "+", "a@", "é" * 10 + "12.34.56.78",
]


def test_pii_base(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(PII_TEXTS + [r[1] for r in X.rows()])]
    docs = spark.createDataFrame(rows, X.DOCUMENT).select("*", *(F.lit(1).alias(c) for c in ("email", "candidates", "added", "card")))
    got = {r["doc_id"]: r for r in pii.found(docs).collect()}
    for i, text, *_ in rows:
        for kind, (pattern, ok) in PII.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
            assert [(s["start"], s["end"]) for s in got[i][kind]] == want, (i, kind)
    assert pii.found(X.none(spark)).collect() == []


def test_pii_adds_what_labelers_agree_on(spark):
    sure = [f"my ssn is 123-45-{1000 + i}" for i in range(30)] + [f"call me on (212) 555-{1000 + i}" for i in range(30)]
    other = [f"order 987-65-{1000 + i} of the version" for i in range(30)] + ["prose without any digits"] * 30
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(sure + other)], X.DOCUMENT)
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in pii.found(docs).collect()}
    assert sum(bool(got[i]) for i in range(60)) == 60 and not any(got[i] for i in range(60, 120))


def test_pii_em():
    model = pii.fit([("ssn", (1, 0, 1, 0), 9, 90), ("ssn", (1, 0, 0, 0), 9, 10), ("ssn", (-1, 0, 0, -1), 9, 100)])
    assert model.reliability["form"] > 0.8 and pii.fit([]).reliability["form"] > 0.55


SECRETS = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
SECRET_TEXTS = ["PassWord: abc token=secret=abcdef api_key='x/y+z=1' apikey  =  \"short\"", "ſecret=abcdefg toKen=abcdefg", "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 14 + "x", "é" * 5 + "f" * 24 + "g" + "a" * 23, None, "", "token=" + "a" * 100_000]


def test_secrets_base(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(SECRET_TEXTS + [r[1] for r in X.rows()])]
    got = {r["doc_id"]: r["spans"] for r in secretscan.scanned(spark.createDataFrame(rows, X.DOCUMENT).withColumn("blob", F.lit(1)).withColumn("spans", F.lit(2))).collect()}
    for i, text, *_ in rows:
        want = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m))
        assert [(s["start"], s["end"], s["kind"]) for s in got[i] if s["kind"] in ("assign", "access", "hex")] == [(a, b, k) for a, _, b, k in want], i
    assert secretscan.scanned(X.none(spark)).collect() == []


def test_secret_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "plain")], "doc_id long, text string")
    first = secretscan.scan(docs, None, secretscan.BASE)
    assert first.count() == 2 and secretscan.scan(docs, first, secretscan.BASE).count() == 0
    newer = (*secretscan.BASE[:1], secretscan.Rule("hex", 2, rb"[0-9a-f]{30,}", 30), secretscan.BASE[1])
    again = secretscan.scan(docs, first, newer)
    assert {tuple(r["rules"]) for r in again.collect()} == {("hex@2",)}
    more = docs.union(spark.createDataFrame([(4, "secret: zzzzzzz")], docs.schema))
    assert secretscan.scan(more, first, secretscan.BASE).count() == 1
    found = {r["doc_id"]: len(r["spans"]) for r in secretscan.scanned(more, None, first, secretscan.BASE).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1}


def test_redaction(spark):
    docs = X.documents(spark, clash=True)
    got = {r["doc_id"]: r for r in secretscan.redacted(docs).collect()}
    assert got[210]["text"] == "é <assign>\" <access> <hex> end" and got[210]["n_chars"] == len(got[210]["text"]) and got[200]["text"] is None and got[203]["n_chars"] == 3
    assert secretscan.redacted(docs).columns == docs.columns


def test_digests_of_queries(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op9_secrets"](spark, FOLDER).collect():
        spans = sorted((m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, ok) in enumerate(SECRETS) for m in p.finditer(docs[r["doc_id"]]) if ok(m))
        assert r["base_sha256"] == hashlib.sha256(",".join(x[2] for x in spans).encode()).hexdigest()
    for r in QUERIES["op5_pii"](spark, FOLDER).collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PII.items() for m in re.finditer(p, docs[r["doc_id"]]) if ok(m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and r["spans"].startswith(",".join(spans))


def plain_histogram(lengths):
    """Rows of op1 from the lengths of all documents."""
    n, total, out = len(lengths), sum(lengths), []
    for k in sorted(set(lengths)):
        longer = [x for x in lengths if x > k]
        out.append((k, lengths.count(k), len(longer), sum(longer), total - sum(longer), sum(min(x, k) for x in lengths), (n - len(longer)) / n))
    return out


def test_op1_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_bpe())
    folder = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    lengths = [len(tokenizer.encode(x or "", add_special_tokens=False).ids) for x in texts]
    columns = ["n_tokens", "n_docs", "docs_longer", "tokens_longer", "tokens_within", "tokens_truncated", "quantile"]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES["op1_token_counts"](spark, folder).collect())
    assert got == [pytest.approx(x) for x in plain_histogram(lengths)]


def test_histogram_of_odd_rows(spark):
    """Null, empty and very long texts, the long ones encoded whole by the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_bpe())
    rows = X.rows() + [(300, "x" * 200_000, "en", "s0", 0), (301, "ab1" * 50_000, "en", "s0", 0)]
    for clash in (False, True):
        docs = spark.createDataFrame(rows, X.DOCUMENT)
        docs = docs.selectExpr("*", "1 as n_tokens", "2 as n_docs", "3 as block") if clash else docs
        got = {r["n_tokens"]: r["n_docs"] for r in tokens.length_histogram(tokens.token_counts(docs, tokens.word_bpe())).collect()}
        assert got == Counter(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)


def test_quality_verdict_is_that_of_its_rules(spark):
    """kept, worked out from plain counts and the learned rules one text at a time."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality.learn(*quality.training_rows(docs, labels), quality.FEATURES)
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op2_quality"](spark, folder).collect()}
    assert rules
    for r in docs.collect():
        text = r["text"] or ""
        words, lines = text.encode().split(), [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n, chars, symbols, dup, repeated = plain_statistics(r["text"])
        per = lambda a, b: a / max(b, 1)
        count = lambda of: sum(c in of for c in text)
        x = {"n_words": n, "chars_per_word": per(chars, n), "symbols_per_word": per(symbols, n), "dup_line_share": per(dup, len(lines)), "repeat_share": per(repeated, n), "words_per_line": per(n, len(lines)), "distinct_share": per(len(set(words)), n)}
        x |= {"upper_share": per(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), "digit_share": per(count("0123456789"), chars), "marks_per_word": per(count(".,;:!?"), n), "longest_word": max(map(len, words), default=0)}
        hit = any(all(x[f] <= at if sign == "<=" else x[f] >= at for f, sign, at in rule.tests) for rule in rules)
        assert kept[r["doc_id"]] == (n >= 10 and 100 * repeated <= 20 * n and not hit), r["doc_id"]
