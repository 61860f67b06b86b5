"""Golden values and properties of the scorers, normalizers and parsers."""

from pyspark.sql import functions as F

from kavsak.functions import parse as P
from kavsak.functions import scan as B
from kavsak.functions import text as T
from kavsak.operators import linkage as L

X = "Örnek mah. Atatürk cad. no:12/3 daire:5 Şişli/İstanbul"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scores(spark):
    n = F.lit(None).cast("double")
    assert one(spark, L.combine(F.lit(80.0), F.lit(100.0), n, (0.8, 0.15, 0.05))) == 83.16
    assert one(spark, L.combine(F.lit(80.0), F.lit(0.0), n, (0.8, 0.15, 0.05))) == 67.37
    assert one(spark, L.combine(F.lit(80.0), F.lit(100.0), F.lit(50.0), (0.8, 0.15, 0.05))) == 81.5
    assert [one(spark, L.geo_score(x, 1.5)) for x in (F.lit(0.75), F.lit(0.0), F.lit(9.0), n)] == [50, 100, 0, 0]
    assert [one(spark, L.digits_score(F.lit(a), F.lit(b))) for a, b in (("no 12/3", "12 x"), ("no 12", "no 13"), ("a", "12"))] == [100, 0, 0]
    assert [L.threshold(x) for x in (0.6, 60, "x", None)] == [60, 60, 80, 80]


def test_blocks(spark):
    x = F.lit("no:12 ataturk cad")
    assert [one(spark, L.block_key(x, m)) for m in ("digits+prefix6", "prefix8", "")] == ["12|no12at", "no12atat", ""]


def test_text_scorers():
    assert L.ratio("kitten", "sitting") == 200 * 4 / 13 and L.ratio("", "") == 100 and L.ratio("a", "") == 0
    assert L.token_set_ratio("a b", "b a c") == 100 and L.token_set_ratio("", "a") == 0
    assert L.partial_ratio("abc", "xxabcxx") == 100


def test_normalizers(spark):
    assert one(spark, T.normalize(F.lit("Örnek  MAH. İstanbul"))) == "örnek mah. istanbul"
    assert one(spark, T.fold(F.lit("çĞı"))) == "cgi"
    assert one(spark, T.unmojibake(F.lit("Ã§ay"))) == "çay"
    assert one(spark, P.clean_a(F.lit("Kadıköy kat 3"))) == "kat adıköy kat at 3"


def test_parsers(spark):
    clean = one(spark, P.clean_a(F.lit(X)))
    assert clean == "örnek mahalle atatürk cadde no 12/3 daire 5 şişli / istanbul"
    a = one(spark, P.parse_a(F.lit(clean))).asDict()
    assert {k: v for k, v in a.items() if v is not None} == {"mahalle": "atatürk", "no": "12", "daire": "3", "il": "istanbul", "confidence": 1.0}
    r = one(spark, P.repair(F.lit(clean), P.parse_a(F.lit(clean)), P.PROVINCES_A)).asDict()
    assert {k: v for k, v in r.items() if v is not None} == {"mahalle": "örnek", "cadde": "atatürk", "no": "12", "daire": "3", "il": "istanbul", "confidence": 0.78}
    assert one(spark, P.parts_text(P.repair(F.lit(clean), P.parse_a(F.lit(clean)), P.PROVINCES_A))) == "il:istanbul | mahalle:örnek | cadde:atatürk | no:12 | daire:3"
    c = one(spark, P.parse_c(P.clean_c(F.lit(X)))).asDict()
    assert {k: v for k, v in c.items() if v is not None} == {"mahalle": "atatürk", "no": "12", "daire": "3", "il": "istanbul", "confidence": 0.95}


def parsed_b(spark, text):
    clean = one(spark, B.clean_b(F.lit(text)))
    return clean, {k: v for k, v in one(spark, B.parse_b(F.lit(clean))).asDict().items() if v is not None}


def test_token_parser(spark):
    assert parsed_b(spark, X) == ("örnek mahalle atatürk cadde no 12/3 daire 5 şişli istanbul", {"mahalle": "örnek", "cadde": "atatürk", "no": "12", "daire": "5", "il": "istanbul", "ilce": "şişli", "confidence": 0.9})
    assert parsed_b(spark, "")[1] == {"confidence": 0.0}
    # numbers belong to streets only; without a name before the word, the one after it counts
    assert parsed_b(spark, "mahalle yeni 5 2001 sokak")[1] == {"mahalle": "yeni", "sokak": "yeni 5 2001", "confidence": 0.4}
    # the last keyword wins, and the first flat after a slash
    assert parsed_b(spark, "no 1/2 no 3/4 kat 5 kat x")[1] == {"no": "3", "daire": "2", "kat": "5", "confidence": 0.3}
    # a slash stays beside a digit and then gives the district
    assert parsed_b(spark, "5/muğla")[1] == {"il": "muğla", "ilce": "5", "confidence": 0.2}
    assert parsed_b(spark, "a b c d apartman x mevkii")[1] == {"bina_adi": "apartman", "mevkii": "x", "confidence": 0.1}


def test_token_normalizers(spark):
    assert one(spark, T.address_tokens(F.lit("Örnek MAH. Gül cd No:5"))) == ["örnek", "mahalle", "gül", "caddesi", "no", "5"]
    assert one(spark, T.normalize_inline(F.lit("Örnek mh. gül cadd. no: 1 2--3 dr. x"))) == "örnek mahalle gül caddesi no 12-3 doktor x"
    assert one(spark, T.normalize_inline(F.lit(None).cast("string"))) == ""


def test_building_repair(spark):
    of = lambda text, now: one(spark, P.repaired_building(F.split(F.lit(text), " "), F.lit(now).cast("string")))
    assert of("no 5 gül apartman", None) == "gül apartman" and of("kat gül apartman", "apartman") == "gül apartman"
    assert of("gül apartman", "lale apartman") == "lale apartman" and of("x y", None) is None and of("apartman", "5 x") == "apartman"


def test_neighbours_of_equal_texts(spark):
    """Equal texts are compared once, and rows get what a search row by row gives."""
    from pyspark.sql import functions as F

    from kavsak.operators import retrieval as V

    words = ["red bolt", "new ring", "red ring", "old rod", "x", None, "red red bolt"]
    docs = spark.createDataFrame([(i, words[i * i % 11 % 7]) for i in range(120)], "id long, text string")
    v = V.tfidf(docs, V.word_terms(F.col("text")))
    for k, answers in ((1, "id % 5 > 0"), (4, "true"), (40, "id % 5 > 0")):
        want = V.neighbours(v.where("id % 5 = 0"), v.where(answers), k)
        near = V.text_neighbours(docs, V.word_terms, F.expr("id % 5 = 0"), F.expr(answers), k)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect()))
    # the join of hits has a row a pair of texts and term, not a pair of rows
    from pyspark.sql import DataFrame

    seen, plain = [], V.neighbours
    V.neighbours = lambda q, i, k=1: (seen.append((q.count(), i.count())), plain(q, i, k))[1]
    try:
        assert isinstance(V.text_neighbours(docs, V.word_terms, F.expr("id % 5 = 0"), F.lit(True), 2), DataFrame)
    finally:
        V.neighbours = plain
    assert max(seen[0]) <= 2 * len(words)


def test_tfidf_by_text(spark):
    """Copies share their text's vector, and count in the weights."""
    from kavsak.operators import retrieval as V

    words = ["red bolt", "new ring", "red ring red", "", None, "ring new"]
    docs = spark.createDataFrame([(i, words[i * i % 11 % 6]) for i in range(60)], "id long, text string")
    rows = lambda df: sorted((r["id"], r["term"], round(r["weight"], 9)) for r in df.collect())
    assert rows(V.tfidf_by_text(docs, V.word_terms)) == rows(V.tfidf(docs, V.word_terms(F.col("text")))) != []


def test_distances_to_many():
    """Columns shared by texts with a common beginning give the plain distances, beyond 64 characters too."""
    import random

    from kavsak.operators import textmatch

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab ç1") for _ in range(rng.randrange(n)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    many = ["", "a" * 64, "b" * 63, "a" * 65, *(text(n) for n in (12, 70, 100) * 8)]
    texts = sorted({"", "x", *(text(n) for n in (3, 12, 80) * 12)})
    for kind, plain in (("levenshtein", distance), ("lcs", L._lcs)):
        for a, got in zip(texts, textmatch.Many(many, kind).values(texts)):
            assert got.tolist() == [plain(a, b) for b in many]


def test_best_by_text(spark):
    """Rows get what ranking all pairs of rows gives, with texts that many rows share and blocks cut into parts."""
    from unittest import mock

    word = lambda i: ("gul", "lale", None, "no 12", "no 3 kat 12", "gul no 1")[i * i % 7 % 6]
    side = lambda n, m: spark.createDataFrame([(i, f"p{i % 2}", "x", (word(i) or "") + " " * (i % 3) + "sk" * (i % m % 4) if i % 13 else None) for i in range(n)], "id long, province string, district string, text string")
    left, right = side(60, 7), side(90, 5)
    for scorer in ("levenshtein", "ratio"):
        for k, least in ((1, 80.0), (3, 60.0), (20, 0.0)):
            pairs = L.candidates(left, right, "province+district").where("left_text IS NOT NULL AND right_text IS NOT NULL")
            want = L.best(L.scored(pairs, scorer, (0.8, 0.15, 0.05), least), k).select("left_id", "right_id", "score")
            with mock.patch.multiple(L, MOST_LEFT=4, MOST_RIGHT=3):
                got = L.best_by_text(left, right, "province+district", scorer, (0.8, 0.15, 0.05), least, k)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_best_of_many():
    """Scores ranked in hundredths are those of the plain scorers, and only what texts don't all begin and end with, once for
    each different beginning, is taken through the table."""
    import random
    from unittest import mock

    from kavsak.operators import textmatch

    rng, weights = random.Random(7), (0.8, 0.15, 0.05)
    text = lambda: "nation mah. " + " ".join(rng.choice(("gul", "no:1", "no:12", "kat 3")) for _ in range(rng.randrange(1, 5))) + " bursa"
    many, texts = [text() for _ in range(150)], sorted({text() for _ in range(90)})

    def plain(a, b, scorer):
        digits = 100.0 if textmatch.runs(a) & textmatch.runs(b) else 0.0
        x = L.ratio(a, b) if scorer == "ratio" else textmatch.Scores([b], scorer, weights).text(distance(a, b), len(a), len(b))
        return textmatch.combined(x, digits, weights)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    columns, step = [], textmatch._column
    for scorer in ("levenshtein", "ratio"):
        for k, least in ((1, 80.0), (3, 95.5), (20, 0.0)):
            with mock.patch.object(textmatch, "_column", lambda up, *more: (columns.append((up.dtype, len(up))), step(up, *more))):
                got = list(textmatch.Scores(many, scorer, weights).best(texts, least, k))
            assert [t for t, _, _ in got] == texts
            for a, places, scores in got:
                want = sorted((-plain(a, b, scorer), j) for j, b in enumerate(many))
                assert list(zip(scores, places)) == [(-s, j) for s, j in want[:k] if -s >= least]
    beginnings = {t[:n] for t in texts for n in range(13, len(t) - 6 + 1)}
    assert {str(d) for d, _ in columns} == {"uint32"} and sum(n for _, n in columns) <= 3 * (len(beginnings) + 20 * (len(texts) // textmatch.BATCH + 1))


def test_best_of_near():
    """Beginnings alone are taken through the table with all texts; a pair is finished only where it may be among the best."""
    import random
    from unittest import mock

    from kavsak.operators import textmatch

    rng, weights = random.Random(5), (0.8, 0.15, 0.05)
    text = lambda names: f"nation mah. {rng.choice(names)} cad. no:{rng.randrange(40)}/{rng.randrange(9)} kat {rng.randrange(5)}"
    many = list(dict.fromkeys(text(["building"]) for _ in range(600)))
    texts = {text(["machinery", "building", "x"]) for _ in range(2000)}
    odd = ["", "nation", "kat 3", many[0] + "9" * 40, many[1][:-1]]

    def plain(a, value):
        scores = [textmatch.combined(100.0 * (1 - int(v) / max(len(a), len(b), 1)), 100.0 if textmatch.runs(a) & textmatch.runs(b) else 0.0, weights) for b, v in zip(many, value)]
        return sorted((-x, j) for j, x in enumerate(scores))

    step = textmatch._column
    for some in (sorted(texts), sorted({*odd, *texts})):
        every, done = [], []
        with mock.patch.object(textmatch, "_column", lambda up, *more: (every.append(up.size), step(up, *more))):
            want = {a: plain(a, x) for a, x in zip(some, textmatch.Many(many, "levenshtein").values(some))}
        for k, least in ((1, 80.0), (3, 80.0), (3, 99.0)):
            with mock.patch.object(textmatch, "_column", lambda up, *more: (done.append(up.size), step(up, *more))):
                got = list(textmatch.Scores(many, "levenshtein", weights).best(some, least, k))
            assert [a for a, _, _ in got] == some and any(x for _, x, _ in got)
            assert all(list(zip(scores, places)) == [(-s, j) for s, j in want[a][:k] if -s >= least] for a, places, scores in got)
        if "" not in some:
            assert sum(done) < 3 * sum(every) * 4 / 5


def test_preview_by_text(spark):
    """Matches bring the texts that a join by id finds."""
    from unittest import mock

    side = lambda n, m: spark.createDataFrame([(i, f"p{i % 2}", "x", f"gul no {i % m} kat {i % 3}" if i % 13 else None) for i in range(n)], "id long, province string, district string, text string")
    left, right = side(60, 7), side(90, 5)
    for k in (1, 3):
        how = (left, right, "province+district", "levenshtein", (0.8, 0.15, 0.05), 80.0, k)
        with mock.patch.multiple(L, MOST_LEFT=4, MOST_RIGHT=3):
            got = L.preview_by_text(*how)
            want = L.preview(L.best_by_text(*how), left, right)
            assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_best_per_right_by_text(spark):
    """The best left row of each right row, of what all left rows get, without a row for each left row and match."""
    from unittest import mock

    word = lambda i: ("gul", "lale", None, "no 12", "no 3 kat 12", "gul no 1")[i * i % 7 % 6]
    side = lambda n, m: spark.createDataFrame([(i, f"p{i % 2}", "x", (word(i) or "") + "sk" * (i % m % 4) if i % 13 else None) for i in range(n)], "id long, province string, district string, text string")
    left, right = side(60, 7), side(90, 5)
    for k, least in ((1, 80.0), (3, 60.0)):
        how = (left, right, "province+district", "levenshtein", (0.8, 0.15, 0.05), least, k)
        want = L.best(L.best_by_text(*how), 1, "right_id", "left_id")
        with mock.patch.multiple(L, MOST_LEFT=4, MOST_RIGHT=3):
            found = L.text_matches(*how)
            assert found.count() == found.select("block", "left_text").distinct().count() < left.where("text IS NOT NULL").count()
            assert sorted(map(tuple, L.best_per_right_by_text(*how).collect())) == sorted(map(tuple, want.collect())) != []


def test_partials():
    import random

    from kavsak.operators import textmatch

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab ç1") for _ in range(rng.randrange(n)))
    texts = ["", "a", "ab" * 32, "b1" * 33, *(text(n) for n in (4, 12, 70) * 15)]
    for many in (["", "b", *(text(n) for n in (5, 14, 30) * 8)], ["ab" * 32, "ba" * 33, *(text(90) for _ in range(12))]):
        got = textmatch.Partials(many).of(texts)
        assert got.tolist() == [[L.partial_ratio(a, b) for b in many] for a in texts]


def test_partial_ratio_by_text(spark):
    """What scoring pair by pair gives; missing texts count as empty ones."""
    word = lambda i: ("gul", "lale mah", "", "no 12", "no 3 kat 12", "gul no 1")[i * i % 7 % 6]
    side = lambda n, m: spark.createDataFrame([(i, f"p{i % 2}", "x", word(i) + " sk" * (i % m % 3) if i % 13 else None) for i in range(n)], "id long, province string, district string, text string")
    left, right = side(40, 7), side(50, 5)
    for k, least in ((1, 80.0), (4, 50.0)):
        want = L.best(L.scored(L.candidates(left, right, "province+district"), "partial_ratio", (0.8, 0.15, 0.05), least), k).select("left_id", "right_id", "score")
        got = L.best_by_text(left, right, "province+district", "partial_ratio", (0.8, 0.15, 0.05), least, k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_token_sets():
    import random

    from kavsak.operators import textmatch

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(("a", "ab", "ba", "b1", "çab", "no:1", "no:12")) * rng.choice((1, 1, 2)) for _ in range(rng.randrange(n)))
    texts = ["", "a", "no:1 kat", *(text(9) for _ in range(60))]
    for many in (["", *(text(7) for _ in range(40))], ["x" * 70 + " ab", "", *(text(30) for _ in range(20))]):
        sets = textmatch.TokenSets(many)
        for a in texts:
            assert sets.of(a).tolist() == [L.token_set_ratio(a, b) for b in many]


def test_pairs_by_text(spark):
    """All pairs of rows that scoring pair by pair gives, with and without places."""
    from unittest import mock

    word = lambda i: ("gul", "lale mah", "", "no 12", "no 3 kat 12", "gul no 1")[i * i % 7 % 6]
    schema = "id long, province string, district string, text string, lat double, lon double"
    side = lambda n, m: spark.createDataFrame([(i, f"p{i % 2}", "x", word(i) + " sk" * (i % m % 3) if i % 13 else None, 36 + i % 9 / 10 if i % 5 else None, 27.0 + i % 4) for i in range(n)], schema)
    left, right, weights = side(40, 7), side(50, 5), (0.8, 0.15, 0.05)
    for scorer, least, km in (("levenshtein", 60.0, 50.0), ("levenshtein", 0.0, None), ("ratio", 70.0, 20.0), ("ratio", 80.0, None), ("token_set_ratio", 50.0, None), ("token_set_ratio", 0.0, 300.0)):
        want = L.scored(L.candidates(left, right, "province+district"), scorer, weights, least, km).select("left_id", "right_id", "score")
        with mock.patch.multiple(L, MOST_LEFT=16, MOST_RIGHT=3, MOST_OUT=50):
            got = L.pairs_by_text(left, right, "province+district", scorer, weights, least, km)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
