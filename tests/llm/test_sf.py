"""Each operator over the smallest data against a plain version."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name, sf=SF):
    import __spark_entry__ as e

    return e.queries()[name](spark, sf)


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_suffix(spark, docs):
    assert rows(run(spark, "op5_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix(docs))


def test_substring(spark, docs):
    assert rows(run(spark, "op6_substring_dedup"), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substring(docs))


def test_near(spark, docs):
    assert rows(run(spark, "op3_near_join"), "doc_id", "class_id", "n_links") == Counter(brute.near(docs))


def test_pii(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op2_pii").collect()}
    for doc, *n, digest, listed in brute.pii(docs):
        r = got[doc]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n and r["base_sha256"] == digest
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_rules(spark, docs):
    df = run(spark, "op10_quality_rules")
    assert rows(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter(brute.rules(docs))
    assert not df.where("kept and base_failed").count()


def test_mixing(spark):
    table = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = defaultdict(int)
    for _, t, s in table:
        sizes[s] += len(brute.words(t))
    goal, source = brute.targets(sizes), {d: s for d, _, s in table}
    got = run(spark, "op9_mixing").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(source)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    again = run(spark, "op9_mixing").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_leaks(spark, docs):
    items = [(r["item_id"], brute.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {(d, i) for d, t in docs for i, w in items if w and len(grams(w, min(5, len(w))) & grams(brute.words(t), min(5, len(w)))) >= 0.9 * len(grams(w, min(5, len(w))))}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op7_decontaminate").collect()}
    assert got == want


def test_lm(spark, docs):
    """Every score, by plain counts; odd rows and small batches too."""
    from kavsak.llm import lm_scoring as L

    docs = [*docs, (10**6, None), (10**6 + 1, " \n"), (None, "one two one two"), (7, "one two one two"), (7, "one two one two")]
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    ws = [brute.words(t) for _, t in docs]
    own = [Counter(zip([None, *w], w)) for w in ws]

    def model(chosen):
        one, two, kept = Counter(), Counter(), defaultdict(float)
        for i in chosen:
            one.update(ws[i])
            two.update(own[i])
            one[None] += bool(ws[i])
        for (a, _), c in two.items():
            kept[a] += max(c - 0.75, 0)
        return one, two, kept, sum(one.values()) - one[None]

    every = range(len(docs))
    models = model([i for i in every if docs[i][0] in labels]), model(every)
    size = len(models[1][0]) - 1 + 2

    def loss(m, i):
        one, two, kept, total = m
        learned = m is models[1] or docs[i][0] in labels
        out = 0.0
        for a, b in zip([None, *ws[i]], ws[i]):
            h = max(one[a], 1)
            c = two[a, b] - own[i][a, b] * learned
            out -= np.log(max(c - 0.75, 0) / h + max(1 - kept[a] / h, 1e-9) * (one[b] + 0.5) / (total + 0.5 * size))
        return out / max(1, len(ws[i]))

    want = sorted((docs[i][0] or -1, len(ws[i]), loss(models[0], i), loss(models[1], i)) for i in every)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(d,) for d in labels] + [(None,)], "doc_id long")
    for options in ({}, {"batch": 3000, "pairs": 5000}, {"batch": 1}):
        got = sorted((r["doc_id"] or -1, r["n_words"], r["target_loss"], r["background_loss"]) for r in L.lm_scoring(df, target, **options).collect())
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)


def measured(spark, name, label, n, held):
    got = {r["doc_id"]: r for r in run(spark, name, "/root/testdata/sf0.1").collect()}
    truth = [(r["doc_id"], r[label]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["doc_id"] in got]
    test = [(got[d]["score"], y) for d, y in truth if zlib.crc32(str(d).encode()) % n == held]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % n == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    acc = np.mean([(s >= 0.5) == bool(y) for s, y in test])
    print(name, "auc", auc, "accuracy", acc, len(pos), len(neg))
    return auc, acc


def test_toxicity(spark):
    auc, acc = measured(spark, "op4_toxicity", "toxic", 5, 0)
    assert auc > 0.85 and acc > 0.93


def test_quality(spark):
    auc, acc = measured(spark, "op8_quality_ranking", "quality", 3, 1)
    assert auc > 0.9 and acc > 0.9
