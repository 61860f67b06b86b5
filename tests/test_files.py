"""Files, commands, streams and models."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kavsak import commands
from kavsak.__main__ import main, parser
from kavsak.functions import parse as P
from kavsak.functions import text as T
from kavsak.operators import classify as C
from kavsak.operators import linkage as L
from kavsak.operators.ordinal import positions, ranked
from kavsak.plans import queries
from kavsak.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def table(path, header, rows, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1254"])
def test_encodings(spark, tmp_path, encoding):
    rows = [["1", "Şişli, Ğ \u20ac ı"], ["2", 'a "b"\nc'], ["3", "İç"]]
    path = table(tmp_path / "x.csv", ["id", "adres ı"], rows, encoding)
    df = files.read_csv(spark, path)
    assert df.columns == ["id", "adres ı"] and sorted(map(list, df.collect())) == rows
    assert files.read_csv(spark, path, limit=2).count() == 2


def test_a_real_replacement_mark_is_utf8(spark, tmp_path):
    path = table(tmp_path / "x.csv", ["a"], [["\ufffd ş"]])
    assert files.read_csv(spark, path).first()["a"] == "\ufffd ş"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "ş", "x")], "id int, t string, n string")
    files.write_json(df, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": 1, "t": "a", "n": None}, {"id": 2, "t": "ş", "n": "x"}]
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["t"] for r in files.read_csv(spark, str(tmp_path / "c")).collect()) == ["a", "ş"]
    assert files.read_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError, match="missing columns: x"):
        files.required(df, "id", "x")
    with pytest.raises(ValueError, match="empty"):
        files.required(df.where("false"), "id", rows=True)
    assert files.set_seeds(7) == 7


def test_cache_follows_content(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    source, folder = str(tmp_path / "s.csv"), str(tmp_path / "cache")
    for text, settings, rows in (("a", (), 1), ("a", (), 1), ("b", (), 2), ("a", ("x",), 3)):
        Path(source).write_text(text)
        assert files.cached(spark, source, folder, make, *settings).count() == rows
    assert len(calls) == 3


def test_normalize_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("\ufefflowercase: true\nregex:\n  - {pattern: '(?P<y>no):', repl: '\\1 '}\n  - {pattern: '(', repl: x}\nstopwords: [ve]\nunknown: 1\n")
    config = files.normalize_config(str(tmp_path / "c.yaml"))
    assert one(spark, T.normalize(F.lit("NO:5 ve İç"), config)) == "no 5 iç"
    assert one(spark, T.normalize(F.lit("a(?<b"), T.NormalizeConfig(regex=((r"(?<!a", "x"), (r"[[:alpha:]&&", "y"))))) == "a(?<b"
    source = table(tmp_path / "in.csv", ["id", "address"], [["1", "Örnek  MAH. İstanbul"]])
    main(["normalize", "--source", source, "--output", str(tmp_path / "out")])
    assert files.read_csv(spark, str(tmp_path / "out")).first()["address_norm"] == "örnek mah. istanbul"
    source = table(tmp_path / "in2.csv", ["id", "other"], [["1", "x"]])
    assert files.normalize_file(spark, source, str(tmp_path / "out2")).columns == ["address", "address_norm"]


def test_compatibility_forms(spark):
    for clean in (P.clean_a, P.clean_c):
        assert one(spark, clean(F.lit("mah. no:\uff11\uff12"))) == one(spark, clean(F.lit("mah. no:12")))
        assert one(spark, clean(F.lit("\ufb01rat sok."))) == one(spark, clean(F.lit("firat sok.")))
    assert one(spark, T.unmojibake(F.lit("Ã§ay Ä±"))) == "Ã§ay Ä±".encode("latin-1").decode("utf-8")
    assert one(spark, T.unmojibake(F.lit("Ã x"))) == "Ã x" and one(spark, T.unmojibake(F.lit("ğ Ã§"))) == "ğ Ã§" and one(spark, T.unmojibake(F.lit(None).cast("string"))) is None


def test_modes_and_side_text(spark):
    parts = F.struct(*(F.lit(v).alias(k) for k, v in zip(P.PARTS, ("m", None, "s", "1", None, None, None, None, "izmir", None))))
    assert one(spark, P.side_text(parts)) == " m s 1 izmir"
    assert one(spark, P.prediction(F.lit("t"), parts, "parts_string")) == "il:izmir | mahalle:m | sokak:s | no:1"
    with pytest.raises(ValueError):
        P.prediction(F.lit("t"), parts, "x")


def test_places(spark):
    df = spark.createDataFrame([(i * i, i % 3) for i in range(200)], "k long, g int")
    assert [r["place"] for r in positions(df, "k", parts=7).orderBy("k").collect()] == list(range(1, 201))
    got = ranked(df, F.col("k") > 400, ["k"], ["g"]).orderBy("g", "k").collect()
    assert [r["place"] for r in got] == [i for g in range(3) for i in range(1, len(range(g, 200, 3)) + 1)]


def test_commands(spark, tmp_path):
    left = table(tmp_path / "l.csv", ["id", "address", "enlem", "boylam"], [["0", "A Sokak 1", "40", "29"], ["1", "B Cadde 2", "", ""], ["2", "zzz", "", ""]])
    right = table(tmp_path / "r.csv", ["id", "address", "lat", "lng"], [["0", "A Sokak 1", "40", "29"], ["1", "B Cadde 2", "41", "29"]])
    (tmp_path / "m.yaml").write_text("method: index\n")
    (tmp_path / "f.yaml").write_text("\ufeffscorer: ratio\nthreshold: 0.8\ntopk: 1\nblock_by: prefix1\nweights: {text: 0.8, digits: 0.15, geo: 0.05}\n")
    index = commands.match(spark, left, right, str(tmp_path / "i"), str(tmp_path / "m.yaml"))
    assert sorted(map(tuple, index.collect())) == [("0", "0", 1.0), ("1", "1", 1.0)]
    out = commands.match(spark, left, right, str(tmp_path / "o"), str(tmp_path / "f.yaml"))
    assert sorted(map(tuple, out.collect())) == [("0", "0", 100.0), ("1", "1", 100.0)]
    assert [r["id"] for r in files.read_csv(spark, str(tmp_path / "o_unmatched_left")).collect()] == ["2"] and not (tmp_path / "o_unmatched_right").exists()
    assert commands.match(spark, table(tmp_path / "e.csv", ["id", "address"], []), right, str(tmp_path / "p")).count() == 0
    build = commands.build(spark, str(tmp_path / "o"), str(tmp_path / "b"))
    assert build.columns == ["id", "match_id", "score"] and build.count() == 2
    assert [r["confidence"] for r in commands.score(spark, table(tmp_path / "s.csv", ["score"], [["83.456"]]), str(tmp_path / "t")).collect()] == [83.46]
    gold = table(tmp_path / "g.csv", ["id", "match"], [["1", "1"], ["2", "0"], ["3", "1"]])
    pred = table(tmp_path / "h.csv", ["id", "match"], [["1", "1"], ["2", "1"], ["9", "0"]])
    assert commands.evaluate(spark, gold, pred) == {"n": 2, "accuracy": 0.5, "f1": round(2 / 3, 6)}
    template = table(tmp_path / "sub.csv", ["key", "note", "answer"], [])
    got = commands.submit(spark, left, template, str(tmp_path / "u"), "parts_string")
    assert got.columns == ["key", "note", "answer"] and {r["note"] for r in got.collect()} == {""}
    cleaned = commands.clean(spark, left, str(tmp_path / "k"), True)
    assert cleaned.columns[:4] == ["id", "address", "address_clean", "mahalle"] and {r["id"] for r in cleaned.collect()} == set()
    assert parser().parse_args(["knn", "--train", "a", "--test", "b", "--output", "c", "--limit", "5"]).limit == 5


def test_knn_and_training(spark, tmp_path):
    words = {"a": "ataturk cadde konak izmir", "b": "gul sokak mamak ankara", "c": "cinar mahalle nilufer bursa"}
    rows = [[str(i), f"{words[k]} no {i % 7} kat {i % 3}", k] for i in range(60) for k in "abc"[i % 3]]
    train = table(tmp_path / "train.csv", ["id", "address", "label"], rows)
    test = table(tmp_path / "test.csv", ["id", "address"], [["1", "Ataturk cadde Konak no 9"], ["2", "sokak mamak"], ["3", "nilufer bursa no 1"], ["4", "??"]])
    near = {r["id"]: r["label"] for r in commands.knn(spark, train, test, str(tmp_path / "n")).collect()}
    assert near == {"1": "a", "2": "b", "3": "c", "4": "a"}
    scores = commands.train(spark, train, test, str(tmp_path / "p"), str(tmp_path / "model"), 2, (("base", "word", 1, 1, 1, 500), ("side", "char", 3, 3, 1, 500)))
    assert scores == {"accuracy": 1.0, "top3": 1.0}
    assert {r["id"]: r["label"] for r in files.read_csv(spark, str(tmp_path / "p")).where("id < 4").collect()} == {"1": "a", "2": "b", "3": "c"}
    assert list(C.Classifier.load(str(tmp_path / "model")).labels.labels) == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["train_predict", "train_reduced"])
def test_classifiers(spark, name):
    got = queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(got) >= 30 and sum(r["label"] == r["predicted"] for r in got) / len(got) > 0.85


def test_svd(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    m = np.random.default_rng(1).normal(size=(30, 6)) * [5, 4, 3, 1, 1, 1]
    rows = spark.createDataFrame([(i, Vectors.sparse(6, range(6), x)) for i, x in enumerate(m.tolist())], ["id", "features"])
    v = C.svd(rows, 3)
    want = np.linalg.svd(m)[2][:3].T
    assert np.allclose(np.abs((v * want).sum(0)), 1, atol=1e-6)
    got = np.array([r["reduced"].toArray() for r in C.projected(rows, v, False).orderBy("id").collect()])
    assert np.allclose(got, m @ v, atol=1e-4)


def test_stream_equals_table(spark, tmp_path):
    from kavsak import streaming

    rows = [["1", "Örnek mah. Atatürk cad. no:12/3 daire:5 Şişli/İstanbul"], ["2", "abc"]]
    (tmp_path / "in").mkdir()
    table(tmp_path / "in" / "a.csv", ["id", "address"], rows[:1])
    stream = streaming.parsed(streaming.addresses(spark, str(tmp_path / "in")))
    for more in (rows[1:], []):
        streaming.run(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        if more:
            table(tmp_path / "in" / "b.csv", ["id", "address"], more)
    want = streaming.parsed(spark.createDataFrame([(int(i), a) for i, a in rows], "id long, address string"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2


def test_scorers_over_pairs(spark):
    """Each scorer's query equals the scorer applied pair by pair."""
    sf = "/root/testdata/sf0.001"
    from kavsak.plans.queries import sides

    left, right = ([r.asDict() for r in df.collect()] for df in sides(lambda n: spark.read.parquet(f"{sf}/{n}.parquet")))
    import re

    runs = lambda x: set(re.findall(r"\d+", x))
    for name, f in (("link_ratio", L.ratio), ("link_token_set", L.token_set_ratio)):
        want = set()
        for a in left:
            for b in right:
                if a["province"] == b["province"]:
                    s = (0.8 * f(a["text"], b["text"]) + 0.15 * (100 if runs(a["text"]) & runs(b["text"]) else 0)) / 0.95
                    if round(s, 2) >= 80:
                        want.add((a["id"], b["id"]))
        got = {(r["left_id"], r["right_id"]) for r in queries()[name](spark, sf).collect()}
        assert got == want
    assert L.partial_ratio("abcd", "xxabxcd") == max(L.ratio("abcd", "xxabxcd"[max(i, 0) : i + 4]) for i in range(-3, 7))


def test_features(spark):
    """Weights are those of the plain TF-IDF of each channel; what is shuffled are sums of terms, not a row for each text and term."""
    from pyspark.sql import functions as F

    from kavsak.operators import retrieval as V

    texts = ["Gül sokak gül no 1", "no 12 çınar sokak", None, "", "gül  no", "İzmir sokak no 1 gül", "x"] * 3
    docs = spark.createDataFrame([(i, t, " a" if i % 2 else " b a") for i, t in enumerate(texts)], "id long, base string, side string")
    channels = (("base", "char", 2, 3, 2, 25), ("base", "word", 1, 2, 3, 9), ("side", "word", 1, 1, 1, 5))
    features = C.Features(docs, channels)
    words = {(r["channel"], r["term"]): r["at"] for r in features.words.collect()}
    want = {}
    for k, (text, kind, low, high, least, most) in enumerate(channels):
        x = F.col(text)
        terms = V.char_terms(x, low, high) if kind == "char" else V.runs(F.regexp_extract_all(x, F.lit("[a-z0-9çğıöşü]+"), F.lit(0)), low, high)
        rows = V.tfidf(docs, terms, least, True, most).collect()
        assert {r["term"] for r in rows} == {t for c, t in words if c == k}
        want |= {(r["id"], words[k, r["term"]]): round(r["weight"], 9) for r in rows}
    rows = features.of(docs).collect()
    got = {(r["id"], int(i)): round(float(x), 9) for r in rows for i, x in zip(r["features"].indices, r["features"].values)}
    assert got == want and sorted(r["id"] for r in rows) == list(range(len(texts))) and all(r["features"].size == features.size for r in rows)
    plan = features.of(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    # labels go with the vectors, which no join then moves
    df = features.of(docs.withColumn("label", F.col("id") % 2), "label")
    assert {(r["id"], r["label"]) for r in df.collect()} == {(i, i % 2) for i in range(len(texts))} and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
