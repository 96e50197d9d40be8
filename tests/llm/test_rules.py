import hashlib
import pickle
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelframe.llm import catalog, lines, pii, quality, toxicity

D = "/root/testdata/sf0.001"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def base(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


SAMPLES = ["a.b@c.d-e.f@g.h", "a@b.c_d@e.f", "@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890", "+1 (555) 010-9999 +12 +1+1234567890 +1 ((((", "😀 é@b.cd user_é.x@mail.example.com", "a" * 5000 + "@" + "b." * 4000 + "c", "9" * 9000, "1 " * 6000, "+1" + "0" * 14 + " (" * 50]


def test_pii_base(spark, odd, none):
    alphabet = st.lists(st.sampled_from(list("a1@.+-( )9é😀_") + ["4111111111111111", "1.2.3.4", "+1 555 010 9999 ", "x@y.z"]), max_size=15).map("".join)
    made: list[str] = []
    settings(max_examples=150, deadline=None)(given(alphabet)(lambda x: made.append(x)))()
    docs = list(enumerate(SAMPLES + made))
    got = {r.doc_id: r for r in pii.summary(pii.detect(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    for i, text in docs:
        want = base(text)
        shown = [f"{k}:{a}:{b}" for a, _, b, k in want]
        n = Counter(k for *_, k in want)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [n[k] for k in PLAIN], text[:80]
        assert got[i].base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(got[i].spans.split(",")) | {""}
    assert pii.summary(pii.detect(odd)).count() == 10 and pii.summary(pii.detect(none)).count() == 0


def test_pii_adds_and_masks(spark):
    docs = [(k, f"{prose(k, 20)} password=abc{k}def456{k}7890 mail me{k}@mail.example.com now") for k in range(30)] + [(100 + k, f"{prose(k, 10)} colour=lightblue width=wide {k}") for k in range(30)]
    found = pii.detect(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc_id: r for r in pii.masked(found).collect()}
    text = docs[3][1]
    assert [text[s.start : s.end] for s in rows[3].all_spans] == ["password=abc3def45637890", "me3@mail.example.com"]
    assert rows[3].masked == text.replace("password=abc3def45637890", "<secret>").replace("me3@mail.example.com", "<email>")
    assert not rows[105].all_spans and rows[105].masked == docs[35][1]
    one = spark.createDataFrame([(1, "call +378282246310005 now 4111111111111111@x.org")], "doc_id long, text string")
    row = pii.masked(pii.detect(one)).first()
    assert [(s.kind, s.start, s.end) for s in row.base] == [("phone", 5, 21), ("card", 6, 21), ("email", 26, 48), ("card", 26, 42)] and row.masked == "call <phone> now <email>"  # overlapping spans merge


def test_pii_classifier_judges_both_ways(spark):
    """Candidates of every kind, real ones and look-alikes that the patterns match as well: posteriors on both sides, and the look-alikes are refused."""
    good = ["password: q7Rk2mZp94xLw0aB", "\"api_key\": \"9f8e7d6c5b4a39281706fedc\"", "auth-token = sk-A1b2C3d4E5f6G7h8", "Dr. Mary Johnson", "contact Robert Smith"]
    bad = ["colour: lightblue", "version = 2.10.3-beta", "on 2024-01-15 there", "Apache License", "page: 1044", "see: https://example.invalid/a/b", "New York City Hall", "in 1999-2004 it", "build 20240115", "chapter-12-section-00034"]
    docs = [(k, f"{prose(k, 12)} {good[k % 5]} {prose(k + 1, 9)} {bad[k % 10]} and mail me{k}@mail.example.com or 4111 1111 1111 1111 not 4111 1111 1111 1112, host 8.8.4.{k % 250}, no 8.8.4.{300 + k}") for k in range(200)]
    rows = pii.judged(spark.createDataFrame(docs, "doc_id long, text string"))
    found, n = pii.patterns(rows)
    post, reliability = pii.label_model(found, n)
    assert (post < 0.05).sum() >= 5 and (post > 0.95).sum() >= 5
    assert all(any(0.01 < chance < 0.99 for pair in votes.values() for chance in pair) for votes in reliability.values())  # no labeler is taken to be always right
    got = {r.doc_id: [(s.kind, r.t[s.start : s.end]) for s in r.all_spans] for r in pii.detect(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    extra = [x for k in got for x in got[k] if x[0] not in pii.BASE]
    assert not [x for x in extra if any(b in x[1] or x[1] in b for b in bad)]
    for g in good[:3]:
        assert sum(x == ("secret", g) for x in extra) == 40
    assert sum(x[0] == "name" for x in extra) == 80 and not [x for x in extra if "1112" in x[1] or x[1].startswith("8.8.4.")]
    kinds = {p[0] for p in found}
    assert {"card", "ip", "email", "secret", "number", "name"} <= kinds


@pytest.mark.parametrize("unit,n", [("a@b.co ", 290_000), ("1.2.3.4 ", 250_000), ("k=1a2b3c4d5e6f7 ", 130_000), ("Mary Smith, ", 170_000), ("1 ", 1_000_000), ("a:", 1_000_000)])
def test_pii_in_long_texts(spark, unit, n):
    """Two MB of matches in one text take some seconds, and come out whole."""
    df = spark.createDataFrame([(1, unit * n), (2, "password=abc3def45637890")], "doc_id long, text string")
    model = pii.train([("secret", 1, 1, 0, 0, 1, 2, 1, 1), ("number", -1, -1, 0, 0, -1, 0, 0, 0)], [10, 10])
    start = time.time()
    rows = {r.doc_id: r for r in pii.masked(pii.detect(df, model)).selectExpr("doc_id", "size(base) as n", "length(masked) as length", "substr(masked, 1, 20) as head").collect()}
    assert time.time() - start < 40
    if "@" in unit or unit.startswith("1.2"):
        kind = "<email> " if "@" in unit else "<ip> "
        assert rows[1].n == n and rows[1].length == n * len(kind) and rows[1].head.startswith(kind)


def test_running_totals(spark):
    for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 1000):
        v = [(k * 7919) % 101 for k in range(n)]
        got = spark.range(1).select(pii.running(F.lit(v).cast("array<int>"), lambda a, b: a + b).alias("s"), pii.running(F.lit(v).cast("array<int>"), F.greatest).alias("m")).first()
        assert got.s == np.cumsum(v).astype(int).tolist() and got.m == np.maximum.accumulate(np.array(v, dtype=int)).tolist()


def test_label_model_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = (0.95, 0.9, 0.6, 0.85, 0.8)
    votes = [tuple(int(np.where(rng.random() < q, 1 if t else -1, -1 if t else 1)) for q in right) for t in truth]
    counted = Counter(votes)
    patterns = [("secret", *v, 0, 0, 0) for v in counted]
    post, table = pii.label_model(patterns, list(counted.values()))
    judged = dict(zip(counted, post > 0.5, strict=True))
    assert np.mean([judged[v] == t for v, t in zip(votes, truth, strict=True)]) > 0.95
    assert table["shape"][1][0] > table["context"][1][0]
    assert pii.train([], []).weights == {}


def test_quality_against_sql_and_brute_force(spark, odd, none, tmp_path):
    docs = [(k, prose(k, 80), "en", f"s{k % 2}", 0) for k in range(120)] + [(200, "a b c " * 40, "en", "s0", 0), (201, prose(1, 60) + "\n" + "\n".join(["same line"] * 30), "en", "s1", 0), (202, " ".join(f"{w}###" for w in prose(9, 90).split()), "fr", "s9", 0), (203, "a b c d a b c", None, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    df.write.parquet(f"{tmp_path}/d")
    rows = quality.quality(df).collect()
    got = {r.doc_id: r for r in rows}
    assert got[200].n_repeat_words == 120 and got[200].base_failed and got[203].n_repeat_words == 6 and got[201].n_dup_lines == 29 and not got[201].kept and not got[202].kept
    assert all(got[k].kept for k in range(120)) and got[900].n_words == 0 and got[905].word_chars == 60_000 and len(rows) == 134
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    r = con.sql(quality.ORACLE_SQL)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str) == sorted((tuple(x[c] for c in sorted(r.columns)) for x in rows), key=str)
    assert quality.quality(none).count() == 0


def test_fences_follow_the_group(spark):
    """The same counts are in order where they are usual and out of order where they are not."""
    marks = lambda k, n: " ".join(w + ("#" if i < n else "") for i, w in enumerate(prose(k, 100).split()))
    again = lambda k: f"{prose(k, 90)}\n" + "\n".join(["once more the same"] * 5)
    docs = [(k, marks(k, 20 + k % 10), "en", "code") for k in range(300)] + [(1000 + k, prose(k, 100), "en", "prose") for k in range(300)] + [(2000 + k, again(k), "en", "verse") for k in range(300)]
    docs += [(5000 + j, marks(7, 25), "en", s) for j, s in enumerate(("code", "prose"))] + [(5100 + j, again(9), "en", s) for j, s in enumerate(("verse", "prose"))] + [(5200, marks(7, 2), "en", "prose"), (5300, "### " * 60 + prose(3, 60), "en", "code"), (5400, marks(5, 90), "xx", "new")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5000] and not got[5001] and got[5100] and not got[5101] and got[5200] and not got[5300]
    assert all(v for k, v in got.items() if k < 5000)


def test_sketches_merge(spark):
    """The sketch of all rows is the sum of the sketches of any parts."""
    m = quality._measures(quality.features(spark.read.parquet(f"{D}/documents.parquet")))
    keys = ["g_lang", "g_source", "measure", "bucket"]
    whole = sorted(map(tuple, quality.sketches(m).select(*keys, "n").collect()))
    halves = quality.sketches(m.where("doc_id % 2 = 0")).union(quality.sketches(m.where("doc_id % 2 = 1")))
    assert sorted(map(tuple, halves.groupBy(*keys).agg(F.sum("n")).collect())) == whole


def test_line_dedup(spark, odd, none):
    docs = [(k, f"Site menu\n{prose(k, 12)}\n\n{'Rare ' + str(k % 40)}\nSite menu", "h1") for k in range(60)] + [(100 + k, "Site menu\nsmall site", "h2") for k in range(3)]
    got = {r.doc_id: r for r in lines.drop_boilerplate(spark.createDataFrame(docs, "doc_id long, text string, s string"), F.col("text"), F.col("s")).collect()}
    assert got[5].clean_text == f"{prose(5, 12)}\n\nRare 5" and (got[5].n_lines, got[5].n_dropped) == (4, 2)
    assert got[101].clean_text == "" and got[101].n_dropped == 2  # the ratio decides on a small site too
    small = [(k, f"own {k}\nshared {k // 2}\nall", "a") for k in range(13)] + [(100 + k, f"own {k}\nshared {k // 2}\nall", "b") for k in range(26)] + [(200, "alone\nalone", "c")]
    got = {r.doc_id: r.clean_text for r in lines.drop_boilerplate(spark.createDataFrame(small, "doc_id long, text string, s string"), F.col("text"), F.col("s")).collect()}
    assert got[3] == "own 3" and got[103] == "own 3\nshared 1" and got[12] == "own 12\nshared 6" and got[200] == "alone\nalone"
    assert lines.drop_boilerplate(odd, F.col("text"), F.col("source")).count() == 10 and lines.drop_boilerplate(none, F.col("text"), F.col("source")).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "HTTPS://u:p@Host.Example:80/x", "<head>no</head><p>One</p><script>var a='<p>';</script><b>two</b> three<br/>four <!-- <p> -->")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in lines.clean_pages(pages).collect()}
    assert rows[1].site == "host.example" and [x for x in rows[1].clean_text.split("\n") if x.strip()] == ["One", "two three", "four "] and rows[None].clean_text == ""


def test_long_pages_in_linear_time(spark):
    """Pages of some MB: tags that are never closed, and two near copies of many lines."""
    wide = "\n".join(f"line {k}" for k in range(60_000))
    rows = [(1, "http://a/", "<script>" * 250_000), (2, "http://a/", "<p " * 700_000), (3, "http://a/", "<" * 2_000_000), (4, "http://a/", "<!-- " * 400_000), (5, "http://b/", wide), (6, "http://b/", wide + "\nmore")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    start = time.time()
    got = {r.page_id: r for r in lines.clean_pages(pages).collect()}
    assert time.time() - start < 30
    assert got[1].clean_text.strip() == "" and got[4].clean_text.strip() == "" and got[5].n_dropped == got[6].n_dropped == 60_000 and got[6].clean_text == "more"


def test_index_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [{int(t): float(np.float32(rng.random())) for t in rng.choice(80, 5, replace=False, p=np.arange(80, 0, -1) / 3240)} for _ in range(700)] + [{1: 1.0}] * 5 + [{79: 2.0}] * 5
    for v in vectors[:200]:  # strong terms weigh more
        v.update({t: 5 * w for t, w in v.items() if t % 7 == 0})
    index = toxicity.BlockMaxIndex([(np.array(sorted(v)), np.array([v[t] for t in sorted(v)])) for v in vectors], np.arange(80) % 7 == 0)
    assert 0 < len(index.rows) < 80 and len(index.first) > 80  # both kinds of postings
    dense = np.zeros((710, 80))
    for d, v in enumerate(vectors):
        for t, w in v.items():
            dense[d, t] = w
    for trial in range(200):
        monkeypatch.setattr(toxicity, "PRUNED", 10_000 * (trial % 2))
        ids = np.sort(rng.choice(80, 6, replace=False))
        q = rng.random(6) * np.where(ids % 7 == 0, 20.0 ** (trial % 4), 1.0)
        s = dense[:, ids] @ q
        want = [d for d in np.lexsort((np.arange(710), -s.round(12)))[:10] if s[d] > 0]
        got = index.search(ids, q, 10)
        assert [d for d, _ in got] == want and np.allclose([x for _, x in got], s[want])
        others = [d for d in np.lexsort((np.arange(710), -s.round(12)))[:11] if s[d] > 0 and d != want[0]][:10]
        assert [d for d, _ in index.search(ids, q, 10, skip=int(want[0]))] == others
    one = np.array([1.0])
    assert [d for d, _ in index.search(np.array([79]), one, 3)] == [705, 706, 707] and 705 not in [d for d, _ in index.search(np.array([79]), one, 3, skip=705)]
    assert toxicity.BlockMaxIndex([], np.empty(0, bool)).search(np.empty(0, np.int64), np.empty(0), 3) == []


def test_rows_of_many_queries_at_once(monkeypatch):
    """Frequent terms of many queries are one product, in single precision; what is found does not depend on the queries beside, and copies tie."""
    rng = np.random.default_rng(5)
    texts = [np.sort(rng.choice(60, 20, replace=False)) for _ in range(300)]
    vectors = [(t, rng.random(20).astype(np.float32).astype(float)) for t in texts]
    vectors += vectors[:40]  # copies
    index = toxicity.BlockMaxIndex(vectors, np.arange(60) % 9 == 0)
    assert index.rows.dtype == np.float32 and len(index.rows) > 40
    dense = np.zeros((340, 60))
    for d, (t, w) in enumerate(vectors):
        dense[d, t] = w
    queries = [(np.sort(rng.choice(60, 12, replace=False)), rng.random(12)) for _ in range(150)] + vectors[:30]
    calls, product = [], toxicity.BlockMaxIndex.nearest
    monkeypatch.setattr(toxicity.BlockMaxIndex, "nearest", lambda self, some, *a: calls.append(len(some)) or product(self, some, *a))
    together = list(index.nearest(queries, 8))
    assert calls == [180]
    skipped = list(index.nearest(vectors, 8, range(340)))
    assert [index.search(*q, 8) for q in queries] == together
    for (ids, w), got in zip(queries, together, strict=True):
        s = dense[:, ids] @ w
        want = np.lexsort((np.arange(340), -s.round(12)))[:8]
        assert [d for d, _ in got] == want.tolist() and np.allclose([x for _, x in got], s[want], rtol=1e-14)
    for d, got in enumerate(skipped[:40]):
        assert got[0][0] == 300 + d and got == index.search(*vectors[d], 8, skip=d)


def test_counter_against_terms():
    """Words of the vocabulary, their beginnings and repetitions, in tokens with marks, other cases and after forgetting."""
    words = ["straße", "grumblefoot", "the", "x1_y", "ας", "grum"]
    vocabulary = sorted([*words, "grum-", "grumb-", "stra-", "other-", "the x2", "absent x2"])
    counter = pickle.loads(pickle.dumps(toxicity.TermCounter(vocabulary)))  # as workers get it
    forms = ["The,", "the", "GRUMBLEFOOT!!", "grum", "grumbling.", "STRAßE-the", "straßen", "others", "other", "x1_y;", "ΑΣ.", "(the)", "absent", "unknown", "İ", "the|the"]
    rng = np.random.default_rng(6)
    for _ in range(300):
        tokens = [forms[k] for k in rng.integers(0, len(forms), rng.integers(0, 12))]
        plain = Counter(x for w in tokens for x in toxicity.terms_of(w))
        want = {i: plain[t] for i, t in enumerate(vocabulary) if toxicity.AGAIN not in t and plain[t]}
        want |= {vocabulary.index(f"{t} x2"): 1 for t in ("the", "absent") if plain[t] >= 2}
        text = " ".join(tokens)
        assert counter.count(text) == want and set(counter.present(text).tolist()) == set(want)
        if rng.random() < 0.2:
            counter.count(" ".join(f"w{rng.integers(1 << 30)}" for _ in range(30_000)))
            assert len(counter.known) <= len(words) + 2 + toxicity.CACHED_TOKENS


def test_scores_equal_a_brute_force_vote(spark):
    """Every document with a known word: cosines with all examples, the nearest fifteen, their vote, calibrated."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert 20 < len(model.ids) and {0, 1} == set(model.labels.tolist())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    counter, size = toxicity.TermCounter(model.vocabulary), len(model.vocabulary)

    def dense(t):
        out = np.zeros(size)
        plain = Counter(x for w in t.split() for x in toxicity.terms_of(w))
        for i, term in enumerate(model.vocabulary):
            stem, _, times = term.partition(toxicity.AGAIN)
            n = plain[stem] if not times else int(plain[stem] >= int(times))
            out[i] = (1 + np.log(n)) * model.weight[i] if n else 0
        length = np.sqrt(out @ out)
        return out / length if length else out

    assert all(set(counter.present(t).tolist()) == set(counter.count(t)) == set(np.flatnonzero(dense(t)).tolist()) for t in text.values())
    examples = np.array([dense(text[i]).astype(np.float32) for i in model.ids], dtype=float)
    words = {w for i in model.ids for w in re.findall(r"\w+", text[i].lower())}
    assert words <= set(model.vocabulary)
    df = np.array([sum(i in c for c in (counter.count(t) for t in text.values())) for i in range(0, size, 997)])
    strong = model.weight[::997] / (np.log((1 + len(text)) / (1 + df)) + 1)
    assert (strong >= toxicity.BASE * 0.999).all()
    for r in toxicity.score_documents(docs.where("doc_id % 5 = 0"), model, evidence=True).collect():
        s = examples @ dense(text[r.doc_id])
        near = [(int(d), float(s[d])) for d in np.lexsort((np.arange(len(s)), -s.round(12)))[:15] if s[d] > 0]
        assert np.allclose([e.cosine for e in r.evidence], [x for _, x in near]) and bool(near) == bool(set(re.findall(r"\w+", text[r.doc_id].lower())) & words)
        assert abs(r.score - (model.calibrated(model.vote(near)) if near else model.plain)) < 1e-6


def test_toxicity(spark, odd, none):
    rude = ["grumblefoot", "snarkwit", "dolthead"]
    docs = [(k, prose(k, 60) + (f" you {rude[k % 3]} {rude[(k + 1) % 3]}s!" if k % 5 == 0 else "")) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(500)] + [(None, 1, 1), (3, None, 1), (10_000, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    rows = toxicity.score_documents(df, model, evidence=True).collect()
    got = {r.doc_id: r for r in rows}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1 or k >= 500]
    assert len(rows) == 610 and np.mean([got[k].predicted == (k % 5 == 0) for k in held]) > 0.97
    near = got[505].evidence
    assert near and near[0].toxic == 1 and all(a.cosine >= b.cosine for a, b in zip(near, near[1:])) and all(zlib.crc32(str(e.doc_id).encode()) % 3 != 1 for e in near)
    assert got[900].score == got[901].score == model.plain and 0 <= model.plain < 0.1
    assert df.select(toxicity.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0
    clean = toxicity.drop_toxic(odd, model)
    assert clean.columns == odd.columns and clean.count() == 10
    named = toxicity.fit(df.selectExpr("cast(doc_id as string) as doc_id", "text"), labels.selectExpr("cast(doc_id as string) as doc_id", "toxic"))
    assert {type(x) for x in named.ids} == {str} and len(named.ids) == len(model.ids)
    again = toxicity.fit(df.union(df).union(df.where("doc_id < 500").selectExpr("doc_id", "concat(text, ' zzz')")), labels)
    assert sorted(again.ids) == sorted(model.ids)  # repeated ids are one example each
    empty = toxicity.fit(none, labels.limit(0))
    assert toxicity.score_documents(none, empty).count() == 0 and toxicity.score_documents(odd, empty).select("score").distinct().collect()[0][0] == 0.0


def test_toxicity_counts_terms_once(spark, odd):
    """Terms saved by the fit give the scores that texts give, row by row, and no text is read again."""
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(k, prose(k, 30) + (" vile scum" if k % 5 == 0 else "")) for k in range(200)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, keep=["doc_id", "text"])
    plain = toxicity.fit(df, labels)
    assert plain.counted is None and model.counted.columns == ["doc_id", "text", toxicity.TERMS, toxicity.COUNTS]
    rows = lambda m, d: sorted(map(tuple, toxicity.score_documents(d, m).collect()), key=str)
    assert rows(model, model.counted.drop("text")) == rows(plain, df) and len(rows(model, model.counted)) == 210
    kept = [toxicity.drop_toxic(d, model) for d in (df, model.counted)]
    assert kept[0].columns == kept[1].columns and sorted(map(str, kept[0].collect())) == sorted(map(str, kept[1].collect())) and 0 < kept[0].count() < 210
    assert toxicity.score_documents(model.counted.limit(0), model).count() == 0


def test_toxicity_keeps_all_terms(spark):
    """Each of 700 rude words, in five toxic documents apiece, passes the tests for terms, is one, and has evidence."""
    words = [f"q{j:03d}" for j in range(700)]
    ids = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 3 != 1][:2400]
    docs = [(k, prose(k, 20) + (" " + " ".join(words[i % 80 :: 80]) if i < 400 else "")) for i, k in enumerate(ids)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(i < 400), 1) for i, k in enumerate(ids)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    assert set(words) <= set(model.vocabulary) and {x for k, t in docs for x in t.split()} <= set(model.vocabulary)  # and the clean ones
    new = spark.createDataFrame([(10_000 + j, f"such a {w}") for j, w in enumerate(words)], "doc_id long, text string")
    assert all(r.evidence for r in toxicity.score_documents(new, model, evidence=True).collect())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, D)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    r = con.sql(catalog.ORACLE[name])
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted(r.columns) == sorted(df.columns)
    assert sorted((tuple(x[c] for c in sorted(df.columns)) for x in df.collect()), key=str) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)
