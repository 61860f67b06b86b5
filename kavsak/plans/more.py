"""Further queries with their SQL: sources and sinks, filters, joins, reports, classification."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators import classify as C
from ..operators import linkage as L
from ..operators import metrics as M
from ..operators import profile as R
from ..operators import quality as Q
from ..operators import retrieval as V
from ..operators.ordinal import ranked
from .queries import BAD, FLAGGED, WORD_SQL, _tfidf_sql, addresses, parts, query


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1000")
def limited_scan(t):
    return t("orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(1000)


@query("SELECT n_nationkey, regexp_replace(regexp_replace(n_name, '\\r?\\n', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS n_name, regexp_replace(r_name || chr(10) || ' x', '\\r?\\n', ' ', 'g') AS r_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def hygiene_all(t):
    df = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.hygiene(df.select("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit("\n")).alias("n_name"), F.concat("r_name", F.lit("\n x ")).alias("r_name"), "n_regionkey"))


#: The configured patterns of components.
PATTERNS = {"mahalle": r"(?:mahalle|mah)\s+([\wçğıöşü]+)", "cadde": r"(?:cadde|cad)\s+([\wçğıöşü]+)", "sokak": r"(?:sokak|sk)\s+([\wçğıöşü]+)", "no": r"no\s*:?\s*(\d+)", "kat": r"kat\s*(\d+)", "daire": r"(?:daire|d)\s*(\d+)"}


@query("WITH {P} SELECT id, " + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '') AS {k}" for k, p in PATTERNS.items()) + " FROM clean")
def parts_by_patterns(t):
    from .queries import cleaned

    return cleaned(t).select("id", P.by_patterns(F.col("t"), PATTERNS).alias("p")).select("id", "p.*")


# filters


NOTHING = "^[\\s!-/:-@\\[-`{-~]*$"


@query(f"WITH d AS (SELECT doc_id, text AS raw, CASE WHEN doc_id % 7 = 0 THEN '. .' ELSE lower(text) END AS clean FROM documents) SELECT doc_id FROM d WHERE NOT (length(raw) < 6 OR length(clean) < 6 OR regexp_matches(raw, '{NOTHING}') OR regexp_matches(clean, '{NOTHING}'))")
def clean_either(t):
    df = t("documents").select("doc_id", F.col("text").alias("raw"), F.when(F.col("doc_id") % 7 == 0, ". .").otherwise(F.lower("text")).alias("clean"))
    return df.where(~Q.bad_either(F.col("raw"), F.col("clean"))).select("doc_id")


@query(f"SELECT doc_id, 1 AS confidence_flag, 1.0::DOUBLE AS sample_weight FROM ({FLAGGED}) WHERE NOT {BAD}")
def trusted_rows(t):
    df = t("documents").select("doc_id", *(v.alias(k) for k, v in Q.flags(F.col("text")).items()))
    return Q.routed(df)[0].select("doc_id", F.lit(1).alias("confidence_flag"), F.lit(1.0).alias("sample_weight"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY count(*), o_orderpriority LIMIT 1) ORDER BY o_orderkey LIMIT 20")
def tail_labels(t):
    last = R.counts(t("orders"), "o_orderpriority").orderBy("n", "o_orderpriority").limit(1).select("o_orderpriority")
    return t("orders").join(F.broadcast(last), "o_orderpriority", "left_semi").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(20)


@query("(SELECT doc_id, n_chars FROM documents WHERE n_chars <= 15 ORDER BY doc_id LIMIT 50) UNION ALL (SELECT doc_id, n_chars FROM documents WHERE n_chars >= 150 ORDER BY doc_id LIMIT 50)")
def extreme_lengths(t):
    return R.extremes(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id")


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, nullif(quality, 0) AS quality, CASE WHEN d.doc_id % 3 > 0 THEN lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL")
def drop_missing(t):
    df = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.nullif("quality", F.lit(0)).alias("quality"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"))
    return df.dropna(subset=["quality", "lang"]).select("doc_id", "quality")


@query("SELECT doc_id, regexp_matches(text, '[^\\p{L}\\p{N}_\\sçğıöşüÇĞİÖŞÜ.:/-]') AS odd FROM documents")
def foreign_characters(t):
    return t("documents").select("doc_id", Q.foreign(F.col("text")).alias("odd"))


@query("(SELECT 'a' AS part, doc_id FROM documents ORDER BY md5('a' || doc_id), doc_id LIMIT 30) UNION ALL (SELECT 'b' AS part, doc_id FROM documents ORDER BY md5('b' || doc_id), doc_id LIMIT 20)")
def samples_union(t):
    one = lambda name, n: t("documents").select(F.lit(name).alias("part"), "doc_id").orderBy(F.md5(F.concat(F.lit(name), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(n)
    return one("a", 30).unionByName(one("b", 20))


# joins


@query("SELECT l.doc_id, l.quality AS match_true, (d.n_chars % 2)::INT AS match_pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def gold_and_guess(t):
    gold = t("labels").select(F.col("doc_id"), F.col("quality").alias("match"))
    return M.paired(gold, t("documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("match")), "doc_id")


@query("SELECT c_custkey, c_name, s_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) LEFT JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON i = j")
def attach_by_position(t):
    return L.attached(t("customer").select("c_custkey", "c_name"), t("supplier").select("s_suppkey", "s_name"), "c_custkey", "s_suppkey").drop("s_suppkey")


@query("WITH {P}, w AS (SELECT id, unnest(string_split(t, ' ')) AS token FROM clean), d AS (SELECT lower(r_name) AS il, translate(n_name, '0123456789_', 'abcdefghij ') AS ilce FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT id, token, min(il) AS il FROM w JOIN (SELECT il, unnest(string_split(lower(ilce), ' ')) AS token FROM d) d USING (token) GROUP BY id, token")
def dictionary_lookup(t):
    """Tokens that a dictionary of provinces and districts knows, with their province."""
    from .queries import cleaned

    known = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = known.select(F.lower("r_name").alias("il"), F.explode(F.split(F.lower(F.translate("n_name", "0123456789_", "abcdefghij ")), " ")).alias("token"))
    return cleaned(t).select("id", F.explode(F.split("t", " ")).alias("token")).join(known, "token").groupBy("id", "token").agg(F.min("il").alias("il"))


@query("SELECT c_custkey AS id, coalesce(TRY_CAST(enlem AS DOUBLE), lat::DOUBLE) AS lat, coalesce(TRY_CAST(boylam AS DOUBLE), TRY_CAST(lng AS DOUBLE)) AS lon FROM (SELECT c_custkey, 36 + c_custkey % 9 / 10.0 AS lat, CASE WHEN c_custkey % 3 = 0 THEN 'x' WHEN c_custkey % 3 = 1 THEN '40.5' END AS enlem, CASE WHEN c_custkey % 2 = 0 THEN '29.25' ELSE '' END AS lng, CASE WHEN c_custkey % 5 = 0 THEN '30.5' END AS boylam FROM customer)")
def place_names(t):
    k = F.col("c_custkey")
    df = t("customer").select(k.alias("id"), (36 + k % 9 / 10.0).alias("lat"), F.when(k % 3 == 0, "x").when(k % 3 == 1, "40.5").alias("enlem"), F.when(k % 2 == 0, "29.25").otherwise("").alias("lng"), F.when(k % 5 == 0, "30.5").alias("boylam"))
    return L.places(df).select("id", F.col("lat").cast("double").alias("lat"), "lon")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'izmir|konak' WHEN c_custkey % 3 = 1 THEN 'x|' ELSE substr(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 1, 8) END AS block FROM customer")
def block_admin(t):
    k = F.col("c_custkey")
    df = t("customer").select(k.alias("id"), F.col("c_name").alias("text"), F.when(k % 3 == 0, " Izmir ").alias("il"), F.when(k % 3 == 0, "KONAK").otherwise("").alias("ilce"), F.when(k % 3 == 1, "X").alias("city"))
    return df.select("id", L.block_key(F.col("text"), "province+district", L.admin_pairs(df)).alias("block"))


@query("SELECT o_orderkey, o_totalprice AS score, round(o_totalprice, 2) AS confidence FROM orders")
def rescore(t):
    return L.rescored(t("orders").select("o_orderkey", F.col("o_totalprice").alias("score")))


# reports


@query("SELECT count(DISTINCT p_type) AS n_values, count(*) AS n_rows, round(count(*)::DOUBLE / count(DISTINCT p_type), 6) AS mean_repeats FROM part")
def label_repeats(t):
    return R.mean_repeats(t("part"), "p_type")


#: Words and their short forms.
VARIANTS = {"mahalle": ("mah", "mh", "mhl"), "cadde": ("cad", "cd"), "sokak": ("sok", "sk"), "no": ("no.", "nr", "numara")}
_ALL = [v for vs in VARIANTS.values() for v in vs]
_HOLDS = "count(*) FILTER (WHERE regexp_matches(lower(text), '\\b{}\\b'))"


@query("WITH {A} " + " UNION ALL ".join("SELECT '%s' AS canonical, %s AS canonical_count, %s FROM addr" % (w, _HOLDS.replace("{}", w), ", ".join('%s AS "%s"' % (_HOLDS.replace("{}", v.replace(".", "\\.")) if v in vs else "NULL::BIGINT", v) for v in _ALL)) for w, vs in VARIANTS.items()))
def variant_pivot(t):
    return R.variants(addresses(t), "text", VARIANTS)


@query("WITH {A} SELECT token, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(replace(regexp_replace(trim(replace(lower(replace(text, 'I', 'ı')), ':', ' ')), ' +', ' ', 'g'), 'mah.', 'mahalle'), 'cad.', 'caddesi'), ' cd ', ' caddesi '), ' ')) AS token FROM addr) GROUP BY token ORDER BY n DESC, token LIMIT 200")
def top_expanded_tokens(t):
    return R.top_tokens(addresses(t), T.address_tokens(F.col("text")))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS unique_text, 0.0::DOUBLE AS missing_text_pct, count(DISTINCT quality) AS unique_quality, round(100.0 * (count(*) - count(quality)) / count(*), 6)::DOUBLE AS missing_quality_pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def basic_info(t):
    return R.info(t("documents").join(t("labels"), "doc_id", "left"), "text", "quality")


@query(
    f"WITH s AS (SELECT d.doc_id, d.text AS address, lower(d.text) AS address_clean, d.lang FROM documents d JOIN ({FLAGGED}) f ON d.doc_id = f.doc_id WHERE {BAD}), "
    f"g AS (SELECT address, address_clean, lang FROM s WHERE NOT (length(address) < 6 OR regexp_matches(address, '{NOTHING}')))"
    f" SELECT (SELECT count(*) FROM s) AS suspicious_rows_in, (SELECT count(*) FROM s) - (SELECT count(*) FROM g) AS dropped_bad_address, (SELECT count(*) FROM g) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS dropped_exact_dups, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) - (SELECT count(DISTINCT address_clean) FROM g) AS dropped_clean_dups, (SELECT count(DISTINCT address_clean) FROM g) AS lowconf_rows_out, (SELECT count(*) FROM ({FLAGGED}) WHERE NOT {BAD}) AS baseline_rows"
)
def cleaning_report(t):
    df = t("documents").select(F.col("text").alias("address"), F.lower("text").alias("address_clean"), "lang", Q.flags(F.col("text"))["is_suspicious"].alias("is_suspicious"))
    return Q.report(*reversed(Q.routed(df)))


def _nearest(t):
    return V.text_neighbours(parts(t), V.word_terms, F.col("id") % 50 == 0, F.col("id") % 50 > 0)


@query(_tfidf_sql(WORD_SQL, "part", "p_partkey") + ", s AS (SELECT q.id AS query_id, v.id AS found_id, round(sum(q.weight * v.weight), 6) AS similarity FROM v q JOIN v ON q.term = v.term WHERE q.id % 50 = 0 AND v.id % 50 > 0 GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, found_id) AS n FROM s) SELECT query_id, p_type AS label, similarity FROM m JOIN part ON p_partkey = found_id WHERE n = 1")
def label_transfer(t):
    return V.transferred(_nearest(t), parts(t))


@query(_tfidf_sql(WORD_SQL, "part", "p_partkey") + ", s AS (SELECT q.id AS query_id, v.id AS found_id, round(sum(q.weight * v.weight), 6) AS similarity FROM v q JOIN v ON q.term = v.term WHERE q.id % 50 = 0 AND v.id % 50 > 0 GROUP BY ALL) SELECT count(*) AS n, round(avg(similarity), 5) AS mean_similarity FROM (SELECT max(similarity) AS similarity FROM s GROUP BY query_id)")
def mean_similarity(t):
    return V.transferred(_nearest(t), parts(t)).agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("mean_similarity"))


@query(
    "WITH s AS (SELECT c_custkey, c_custkey % 3 AS fold, c_nationkey % 5 AS truth, k, (c_custkey * (k + 3) * 7919) % 1009 AS score FROM customer, (SELECT unnest(range(0, 5)) AS k)),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, k) AS place FROM s), f AS (SELECT fold, count(*) FILTER (k = truth AND place <= 3)::DOUBLE / count(DISTINCT c_custkey) AS a FROM r GROUP BY fold)"
    " SELECT count(*) AS folds, round(avg(a), 5) AS mean_accuracy FROM f"
)
def eval_top3_folds(t):
    scores = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("c_custkey") * (k + 3) * 7919) % 1009)
    df = t("customer").select((F.col("c_custkey") % 3).alias("fold"), (F.col("c_nationkey") % 5).alias("truth"), scores.alias("scores"))
    return M.top_k_by(df, "fold", "truth", "scores").agg(F.count("*").alias("folds"), F.round(F.avg("accuracy"), 5).alias("mean_accuracy"))


# retrieval and classification


def _capped(sql: str, least: int, most: int) -> str:
    """Only the ``most`` terms with most occurrences of those in ``least`` documents."""
    return sql.replace("n AS (SELECT count(*) AS docs", f"k AS (SELECT term FROM c GROUP BY term HAVING count(*) >= {least} ORDER BY sum(tf) DESC, term LIMIT {most}), n AS (SELECT count(*) AS docs").replace("w AS (SELECT id, c.term, tf", "w AS (SELECT id, c.term, tf", 1).replace("FROM c JOIN d", "FROM (SELECT c.* FROM c JOIN k USING (term)) c JOIN d", 1)


CHARS_SQL = "flatten(list_transform([3, 4, 5, 6], lambda n: list_transform(range(1, greatest(length(p_name) - n + 2, 1)), lambda i: substr(lower(p_name), i, n))))"
PADDED_SQL = "flatten(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) - n + 4, 1)), lambda i: substr(' ' || w || ' ', i, n))))))"
RUNS_SQL = "list_concat(regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b'), list_transform(range(1, greatest(len(regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')), 1)), lambda i: regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')[i] || ' ' || regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')[i + 1]))"


@query(_capped(_tfidf_sql(CHARS_SQL, "part", "p_partkey"), 1, 500) + " SELECT id, term, round(weight, 6) AS weight FROM v")
def tfidf_chars(t):
    return V.tfidf(parts(t), V.char_terms(F.col("text"), 3, 6), most=500).withColumn("weight", F.round("weight", 6))


@query(_tfidf_sql(PADDED_SQL, "part", "p_partkey") + " SELECT id, term, round(weight, 6) AS weight FROM v")
def tfidf_padded(t):
    return V.tfidf_by_text(parts(t), lambda x: V.padded_terms(x, 3, 5)).withColumn("weight", F.round("weight", 6))


@query(_capped(_tfidf_sql(RUNS_SQL, "part", "p_partkey"), 3, 300) + " SELECT id, term, round(weight, 6) AS weight FROM v")
def tfidf_runs(t):
    return V.tfidf(parts(t), V.word_terms(F.col("text"), 2), 3, most=300).withColumn("weight", F.round("weight", 6))


def _languages(t):
    """Texts and the language as their label; the side channel holds the source's name."""
    return t("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("base"), F.concat(F.lit(" "), "source").alias("side"), F.col("lang").alias("label"))


@query()
def train_predict(t):
    """Two-channel features, a balanced model on four fifths of the rows, labels and probabilities for the rest."""
    rows = _languages(t)
    train, test = rows.where("id % 5 > 0"), rows.where("id % 5 = 0")
    features = C.Features(train, (("base", "char", 3, 3, 3, 2000), ("base", "word", 1, 1, 3, 2000), ("side", "word", 1, 1, 3, 100)))
    model = C.Classifier(features.of(train, "label"), rounds=15)
    return model.predict(features.of(test, "label")).select("id", "label", "predicted", F.round(F.array_max("probabilities"), 6).alias("confidence"), F.size("probabilities").alias("n_classes"))


@query()
def train_reduced(t):
    """The same through a truncated SVD."""
    rows = _languages(t)
    train, test = rows.where("id % 5 > 0"), rows.where("id % 5 = 0")
    features = C.Features(train, (("base", "word", 1, 1, 3, 1500),))
    fitted = features.of(train, "label")
    v = C.svd(fitted, min(8, features.size))
    model = C.Classifier(C.projected(fitted, v), "reduced", balanced=False, rounds=15)
    return model.predict(C.projected(features.of(test, "label"), v)).select("id", "label", "predicted")


@query("SELECT p_partkey AS id, p_type AS label FROM part")
def label_round_trip(t):
    """Labels as numbers and back."""
    types = t("part").select("p_type").distinct()
    coded = ranked(types, F.ascii("p_type"), ["p_type"], name="code")
    codes = t("part").join(coded, "p_type").select(F.col("p_partkey").alias("id"), "code")
    return codes.join(coded, "code").select("id", F.col("p_type").alias("label"))


@query("SELECT * FROM (VALUES ('izmir', 'konak'), ('izmir', 'bornova'), ('bursa', NULL), ('ankara', NULL)) AS v(province, district)")
def json_dictionary(t):
    """A dictionary written as a JSON file and read; objects that hold no districts keep their province."""
    from ..sources import files

    spark = t("nation").sparkSession
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/dictionary"
    spark.createDataFrame([('{"izmir": {"konak": 1, "bornova": 2}, "bursa": {}, "ankara": 3}',)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    return files.read_dictionary(spark, folder)
