"""Nulls, blanks, ties, repeated rows, clashing columns, long texts and empty tables."""

import random
from collections import Counter

import brute
import pytest


def text_of(seed, n, words=2000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


BASE = text_of(1, 400)
ROWS = [
    (1, BASE, "en", "a", 7),
    (2, BASE, "en", "b", 7),
    (2, BASE, "en", "b", 7),
    (3, BASE.replace("w1", "v1", 3), "en", None, 7),
    (None, BASE, None, None, 7),
    (4, None, "en", "a", None),
    (5, "", "en", "a", None),
    (6, " \t\n ", "de", "c", None),
    (7, "one two three", "de", "c", None),
    (8, "one two three", "de", "c", None),
    (9, "a" * 1500, "de", "c", None),
    (10, "ab " * 400, "de", "c", None),
    (11, text_of(2, 60) + " " + BASE[:900] + " " + text_of(3, 30), "fr", "é", 1),
    (12, text_of(4, 20000, 100), "fr", "ä", 1),
    (13, "mail a.b@c.de or 1.2.3.4, 256.1.1.1, +1 (743) 555-3824, 4111 1111 1111 1111, a@b.c_x@d.e " + text_of(5, 80), "fr", "z", 1),
    (14, "ünïcode çağrı ş " * 40, "tr", "z", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS h", "1 AS copies", "2 AS a", "'k' AS kind")


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("hot", [60_000, 1])
def test_suffix(docs, plain, empty, hot):
    from kavsak.llm.suffix_dedup import suffix_dedup

    assert rows(suffix_dedup(docs, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix(plain))
    assert not suffix_dedup(empty).count()


@pytest.mark.parametrize("hot", [60_000, 1])
def test_substring(docs, plain, empty, hot):
    from kavsak.llm.substring_dedup import substring_dedup

    assert rows(substring_dedup(docs, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substring(plain))
    assert not substring_dedup(empty).count()


def test_deep_shallow():
    import numpy as np

    from kavsak.llm.suffix_dedup import equal_suffixes

    rng = np.random.default_rng(1)
    for width in (5, 13, 40, 200):
        block = rng.integers(97, 99, 300).astype(np.uint8)
        data = np.concatenate([block, rng.integers(97, 99, 200).astype(np.uint8), block])
        pos = np.arange(len(data) - width)
        group = rng.integers(0, 2, len(pos))
        seen = Counter((g, data[p : p + width].tobytes()) for p, g in zip(pos, group))
        want = [seen[g, data[p : p + width].tobytes()] > 1 for p, g in zip(pos, group)]
        assert equal_suffixes(data, pos, group, width).tolist() == want


@pytest.mark.parametrize("most", [3000, 2])
def test_near(spark, docs, plain, empty, most):
    from kavsak.llm.near_join import keep_one, near_classes

    rng = random.Random(3)
    more = []
    for i in range(30):
        w = BASE.split()
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"n{i}"
        more.append((100 + i, " ".join(w)))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    assert rows(near_classes(every, most=most), "doc_id", "class_id", "n_links") == Counter(brute.near(plain + more))
    assert not near_classes(empty).count()
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    low = {c for d, c, _ in brute.near(plain) if c is not None}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(low | {4, 5, 6})


def test_rules(docs, plain, empty):
    from kavsak.llm.quality_rules import keep, score

    assert rows(score(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter(brute.rules(plain))
    assert not score(empty).count() and not keep(empty).count() and keep(docs).columns == docs.columns


def test_pii(docs, plain, empty):
    from kavsak.llm.pii import find, redact

    want = Counter(tuple(r[:6]) for r in brute.pii(plain))
    assert rows(find(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert not find(empty).count() and not redact(empty).count()
    out = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert out[13].startswith("mail [EMAIL] or [IP], 256.1.1.1, [PHONE], [CARD], [EMAIL][EMAIL] ") or "[EMAIL] or [IP]" in out[13]
    assert out[4] is None and out[1] == BASE and redact(docs).columns == docs.columns


def test_leaks(spark, docs, empty):
    from kavsak.llm.decontaminate import keep_clean, leaks

    bench = spark.createDataFrame([(1, " ".join(BASE.split()[5:45])), (2, None), (3, ""), (4, text_of(99, 40)), (5, " ".join(BASE.split()[5:45]))], "item_id long, text string")
    got = rows(leaks(docs, bench), "doc_id", "item_id")
    assert got == Counter((d, i) for d in (1, 2, 2, 3, None, 11) for i in (1, 5))
    assert not leaks(empty, bench).count() and not leaks(docs, bench.where("false")).count()
    clean = keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {4, 5, 6, 7, 8, 9, 10, 12, 13, 14}


def test_leaks_of_long_items(spark):
    from kavsak.llm.decontaminate import keep_clean, leaks

    item = lambda k, n: " ".join(f"i{k}x{j}" for j in range(n))
    long = {1: item(1, 400), 2: item(2, 300) + "\n" + item(9, 100), 3: item(3, 129), 4: item(4, 65), 5: item(5, 40)}
    bench = spark.createDataFrame(list(long.items()), "item_id long, text string")
    around = text_of(7, 90)
    # an item whole; whole at another place; most of one; a fifth of it, which is no leak
    table = [(k, around + " " + t + " " + around) for k, t in long.items()] + [(10 + k, text_of(8, 7 * k) + " " + t) for k, t in long.items()]
    table += [(21, around + " " + " ".join(item(1, 400).split()[:370])), (31, around + " " + " ".join(item(1, 400).split()[:80]))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(leaks(docs, bench), "doc_id", "item_id") == Counter([(k, k) for k in long] + [(10 + k, k) for k in long] + [(21, 1)])
    assert [r["doc_id"] for r in keep_clean(docs, bench).collect()] == [31]


def test_mixing(docs, empty):
    from kavsak.llm.mixing import mixed, takes

    got = takes(docs, chunk=4).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    sizes = {}
    for _, t, _, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    goal = brute.targets(sizes)
    assert all(abs(r["target"] - goal[r["source"]]) < 1e-6 for r in got)
    assert not takes(empty).count()
    assert mixed(docs, chunk=4).count() == sum(r["copies"] for r in got)


def test_fly_keeps_sums():
    import numpy as np

    from kavsak.llm.mixing import fly, land

    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 1000, 500).astype(float), rng.random(500)
    out = fly(size, p, 3)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs((out * size).sum() - (p * size).sum()) < 1e-4 and abs(out.sum() - p.sum()) < 1e-6
    assert set(land(size, out)) <= {0.0, 1.0}


def test_learners(spark, docs, empty):
    from kavsak.llm.entries import fold
    from kavsak.llm.lm_scoring import lm_scoring
    from kavsak.llm.quality_ranking import quality
    from kavsak.llm.toxicity import toxicity

    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in (1, 2, 3, 7, 9, 10, 11, 12, 14)] + [(1, 0, True), (None, 1, True)], "doc_id long, quality int, t boolean").selectExpr("doc_id", "quality", "int(t) AS toxic")
    held = fold(5, lambda r: r == 0)
    for table, n in ((docs, len(ROWS)), (empty, 0)):
        for marks in (labels, labels.where("false")):
            for df in (toxicity(table, marks, held), quality(table, marks, held)):
                got = df.collect()
                assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
            got = lm_scoring(table, marks).collect()
            assert len(got) == n and all(r["n_words"] or r["ce_diff"] == 0 for r in got)
