"""Each query with the SQL that gives the same rows. {A} in the SQL stands for the composed addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import scan as B
from ..functions import text as T
from ..operators import linkage as L
from ..operators import metrics as M
from ..operators import profile as R
from ..operators import quality as Q
from ..operators import retrieval as V
from ..operators.ordinal import positions
from ..sources import files

#: name -> (function of a reader of tables, SQL or None)
REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql.replace("{A}", ADDRESSES).replace("{S}", SIDES).replace("{P}", PARSED) if sql else None)
        return f

    return add


#: Texts are composed alike in both dialects and in ASCII.
TEXT = "concat('Ataturk ', lower(c_mktsegment), ' mah. ', translate(n_name, '0123456789_', 'abcdefghij '), ' cad. ', c_custkey % 500 + 1000, ' sokak no:', c_custkey % 97 + 1, '/', c_custkey % 9 + 1, ' kat ', c_custkey % 5, CASE c_custkey % 4 WHEN 0 THEN ' cinar mevkii' WHEN 1 THEN ' gul apartman' ELSE '' END, ' ', CASE c_custkey % 3 WHEN 0 THEN 'bodrum/izmir' WHEN 1 THEN 'konak / ankara' ELSE 'merkez bursa' END)"
ADDRESSES = f"addr AS (SELECT c_custkey AS id, {TEXT} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)"
#: What a light cleaning makes of them: lower case, mah. and cad. expanded, no: opened.
CLEAN = "regexp_replace(replace(replace(replace(lower(text), 'mah.', 'mahalle'), 'cad.', 'cadde'), 'no:', 'no '), ' +', ' ', 'g')"
PARSED = f"{ADDRESSES}, clean AS (SELECT id, {CLEAN} AS t FROM addr)"
LEFT = "concat(translate(n_name, '0123456789_', 'abcdefghij '), ' mah. ', c_mktsegment, ' cad. no:', c_custkey % 97, '/', c_custkey % 9, ' kat ', c_custkey % 5)"
RIGHT = "concat(translate(n_name, '0123456789_', 'abcdefghij '), ' mah. BUILDING cad. no:', s_suppkey % 97, '/', s_suppkey % 9, ' kat ', s_suppkey % 5)"
SIDES = (
    f"l AS (SELECT c_custkey AS id, lower({LEFT}) AS text, n_name AS province, 'x' AS district, 36 + c_custkey % 100 / 100.0 AS lat, 27 + c_custkey % 300 / 100.0 AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey),"
    f" r AS (SELECT s_suppkey AS id, lower({RIGHT}) AS text, n_name AS province, 'x' AS district, 36 + s_suppkey % 100 / 100.0 AS lat, 27 + s_suppkey % 300 / 100.0 AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)


def addresses(t) -> DataFrame:
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.expr(TEXT).alias("text"))


def cleaned(t) -> DataFrame:
    x = T.literals(T.tr_safe_lower(F.col("text")), {"mah.": "mahalle", "cad.": "cadde", "no:": "no "})
    return addresses(t).select("id", T.collapse(x).alias("t"))


def sides(t) -> tuple[DataFrame, DataFrame]:
    def side(table, key, nation, text):
        k = F.col(key)
        return t(table).join(t("nation"), F.col(nation) == F.col("n_nationkey")).select(k.alias("id"), T.normalize(F.expr(text)).alias("text"), F.col("n_name").alias("province"), F.lit("x").alias("district"), (36 + k % 100 / 100.0).alias("lat"), (27 + k % 300 / 100.0).alias("lon"))

    return side("customer", "c_custkey", "c_nationkey", LEFT), side("supplier", "s_suppkey", "s_nationkey", RIGHT)


DIGITS = "CASE WHEN list_has_any(regexp_extract_all(l.text, '[0-9]+'), regexp_extract_all(r.text, '[0-9]+')) THEN 100.0 ELSE 0.0 END"
RATIO = "100.0 * (1 - levenshtein(l.text, r.text) / greatest(length(l.text), length(r.text), 1)::DOUBLE)"
PAIRS = "SELECT l.id AS left_id, r.id AS right_id, round(({R} * 0.8 + {D} * 0.15) / 0.95, 2) AS score FROM l JOIN r ON l.province = r.province".replace("{R}", RATIO).replace("{D}", DIGITS)
WEIGHTS, LEAST = (0.8, 0.15, 0.05), 80.0


def linked(t, k: int = 3, how=L.best_by_text) -> DataFrame:
    left, right = sides(t)
    return how(left, right, "province+district", "levenshtein", WEIGHTS, LEAST, k)


TOP = f"{{S}}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS n FROM ({PAIRS}) WHERE score >= 80) WHERE n <= 3)"


@query(f"WITH {TOP} SELECT left_id, right_id, score FROM m")
def link_levenshtein_topk(t):
    return linked(t)


@query(f"WITH {TOP} SELECT id, text FROM l WHERE id NOT IN (SELECT left_id FROM m)")
def unmatched_left(t):
    # a row has one match if it has any
    return L.unmatched(sides(t)[0], linked(t, 1), "left_id")


@query(f"WITH {TOP} SELECT id, text FROM r WHERE id NOT IN (SELECT right_id FROM m)")
def unmatched_right(t):
    # the rows of a text have the same matches
    found = linked(t, how=L.text_matches).select(F.explode("found.id").alias("right_id"))
    return L.unmatched(sides(t)[1], found, "right_id")


@query(f"WITH {TOP} SELECT left_id, l.text AS left_text, right_id, r.text AS right_text, score FROM m LEFT JOIN l ON l.id = left_id LEFT JOIN r ON r.id = right_id")
def match_preview(t):
    return linked(t, how=L.preview_by_text)


@query(f"WITH {TOP} SELECT left_id, right_id, score FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY score DESC, left_id) AS k FROM m) WHERE k = 1")
def link_best_per_right(t):
    return linked(t, how=L.best_per_right_by_text)


@query("WITH {S}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM l), b AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM r) SELECT a.id AS left_id, b.id AS right_id, 1.0::DOUBLE AS score FROM a JOIN b USING (i)")
def link_index(t):
    return L.by_position(*sides(t))


KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))))"


@query("WITH {S} SELECT l.id AS left_id, r.id AS right_id, round(%s, 6) AS km, round(100.0 * (1 - least(greatest(%s, 0.0), 50.0) / 50.0), 6) AS geo FROM l JOIN r ON l.province = r.province" % (KM, KM))
def link_geo(t):
    left, right = sides(t)
    km = L.haversine_km(*(F.col(c).cast("double") for c in ("left_lat", "left_lon", "right_lat", "right_lon")))
    return L.candidates(left, right, "province+district").select("left_id", "right_id", F.round(km, 6).alias("km"), F.round(L.geo_score(km, 50.0), 6).alias("geo"))


@query("WITH {S} SELECT l.id AS left_id, r.id AS right_id, %s::DOUBLE AS digits FROM l JOIN r ON l.province = r.province" % DIGITS)
def link_digits(t):
    left, right = sides(t)
    return L.candidates(left, right, "province+district").select("left_id", "right_id", F.when(F.arrays_overlap("left_runs", "right_runs"), 100.0).otherwise(0.0).alias("digits"))


@query("WITH {S} SELECT left_id, right_id, score FROM (SELECT l.id AS left_id, r.id AS right_id, round((%s * 0.8 + %s * 0.15 + 100.0 * (1 - least(greatest(%s, 0.0), 50.0) / 50.0) * 0.05) / 1.0, 2) AS score FROM l JOIN r ON l.province = r.province) WHERE score >= 75" % (RATIO, DIGITS, KM))
def link_combined(t):
    left, right = sides(t)
    return L.pairs_by_text(left, right, "province+district", "levenshtein", WEIGHTS, 75.0, 50.0)


@query("WITH {S} SELECT left_id, right_id, score FROM (SELECT l.id AS left_id, r.id AS right_id, round((%s * 0.8 + %s * 0.15) / 0.95, 2) AS score FROM l CROSS JOIN r WHERE r.id %% 50 = 0) WHERE score >= 95" % (RATIO, DIGITS))
def link_unblocked(t):
    """Without blocks: the stated query set, suppliers whose id is divisible by 50, against all customers."""
    left, right = sides(t)
    return L.scored(L.candidates(left, right.where("id % 50 = 0"), "", salt=8), "levenshtein", WEIGHTS, 95.0).select("left_id", "right_id", "score")


STOPS = ("mah.", "cad.", "kat", "nation")


@query("WITH {S} SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r ON l.province = r.province WHERE list_has_any(list_filter(string_split(l.text, ' '), lambda x: x NOT IN %s), list_filter(string_split(r.text, ' '), lambda x: x NOT IN %s))" % (STOPS, STOPS))
def link_gate(t):
    return L.candidates(*sides(t), "province+district", STOPS).select("left_id", "right_id")


@query()
def link_ratio(t):
    left, right = sides(t)
    return L.pairs_by_text(left, right, "province+district", "ratio", WEIGHTS, 80.0)


@query()
def link_partial_ratio(t):
    left, right = sides(t)
    return L.best_by_text(left, right, "province+district", "partial_ratio", WEIGHTS, 80.0, 1)


@query()
def link_token_set(t):
    left, right = sides(t)
    return L.pairs_by_text(left, right, "province+district", "token_set_ratio", WEIGHTS, 80.0)


ALNUM = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"


@query("WITH {A} SELECT id, substr(%s, 1, 8) AS block FROM addr" % ALNUM)
def block_prefix8(t):
    return addresses(t).select("id", L.block_key(F.col("text"), "prefix8").alias("block"))


@query("WITH {A} SELECT id, concat(regexp_extract(text, '[0-9]+'), '|', substr(%s, 1, 6)) AS block FROM addr" % ALNUM)
def block_digits_prefix6(t):
    return addresses(t).select("id", L.block_key(F.col("text"), "digits+prefix6").alias("block"))


@query("WITH {S} SELECT id, concat(lower(province), '|x') AS block FROM l")
def block_province(t):
    left, _ = sides(t)
    return left.select("id", L.block_key(F.col("text"), "province+district", [(F.col("province"), F.col("district"))]).alias("block"))


@query("SELECT doc_id, md5(lower(text)) AS out FROM documents")
def norm_lower_tr(t):
    return t("documents").select("doc_id", F.md5(T.tr_safe_lower(F.col("text")).cast("binary")).alias("out"))


@query("SELECT doc_id, md5(translate(text, 'çğışöüÇĞİÖŞÜ', 'cgisoucgiosu')) AS out FROM documents")
def norm_fold(t):
    return t("documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("out"))


RULES = T.NormalizeConfig(regex=((r"no:(\d+)", r"no \1"),), replace={"/": " "}, abbreviations={"mah": "mahalle", "cad": "cadde"}, stopwords=("kat",), strip_punctuation=True)


@query("WITH {A}, a AS (SELECT id, regexp_replace(regexp_replace(replace(regexp_replace(lower(text), 'no:([0-9]+)', 'no \\1', 'g'), '/', ' '), '\\bmah\\b', 'mahalle', 'g'), '\\bcad\\b', 'cadde', 'g') AS x FROM addr) SELECT id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '' AND w <> 'kat'), ' '), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS out FROM a")
def norm_rules(t):
    return addresses(t).select("id", T.normalize(F.col("text"), RULES).alias("out"))


@query("WITH {A} SELECT id, trim(regexp_replace(regexp_replace(text, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS out FROM addr")
def norm_punct_ws(t):
    return addresses(t).select("id", T.collapse(T.strip_punctuation(F.col("text"))).alias("out"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\r?\\n', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS out FROM documents")
def norm_one_line(t):
    return t("documents").select("doc_id", F.md5(T.one_line(F.col("text")).cast("binary")).alias("out"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS out FROM documents")
def norm_null_tokens(t):
    return t("documents").select("doc_id", T.null_tokens(F.when(F.col("lang") == "en", "NaN").otherwise(F.col("lang"))).alias("out"))


@query("WITH {P} SELECT id, nullif(regexp_extract(t, '\\bno ?([0-9]+)/([0-9]+)\\b', 1), '') AS no, nullif(regexp_extract(t, '\\bno ?([0-9]+)/([0-9]+)\\b', 2), '') AS daire FROM clean")
def parse_no_daire(t):
    no, flat = P.house(F.col("t"))
    return cleaned(t).select("id", no.alias("no"), F.coalesce(flat, P.numbered(F.col("t"), "daire")).alias("daire"))


@query("WITH {P} SELECT id, nullif(regexp_extract(t, '\\bkat ?([0-9]+[a-z]?)\\b', 1), '') AS kat FROM clean")
def parse_kat(t):
    return cleaned(t).select("id", P.numbered(F.col("t"), "kat").alias("kat"))


@query("WITH {P} SELECT id, nullif(regexp_extract(t, '\\b([0-9]+) +sokak\\b', 1), '') AS sokak FROM clean")
def parse_street_number(t):
    return cleaned(t).select("id", P.numbered_street(F.col("t")).alias("sokak"))


@query("WITH {P} SELECT id, nullif(regexp_extract(t, '\\b([a-z-]+) +mevkii\\b', 1), '') AS mevkii FROM clean")
def parse_mevkii(t):
    return cleaned(t).select("id", P.locality(F.col("t")).alias("mevkii"))


@query("WITH {P} SELECT id, CASE WHEN regexp_matches(t, '\\bapartman\\b') THEN array_to_string(list_slice(regexp_extract_all(regexp_extract(t, '^(.*?)\\bapartman\\b', 1), '[a-z-]+'), -2, -1), ' ') || ' apartman' END AS x FROM clean")
def parse_building(t):
    return cleaned(t).select("id", P.building(F.col("t"), P.TRIGGERS_A).alias("x"))


@query("WITH {P}, p AS (SELECT id, list_reverse(string_split(t, '/')) AS p FROM clean), f AS (SELECT id, list_filter(list_transform(p, lambda x: list_filter(%s, lambda w: list_contains(string_split(x, ' '), w))), lambda h: len(h) > 0) AS il, list_filter(list_transform(p, lambda x: list_filter(%s, lambda w: list_contains(string_split(x, ' '), w))), lambda h: len(h) > 0) AS ilce FROM p) SELECT id, il[1][1] AS il, ilce[1][1] AS ilce FROM f" % (list(P.PROVINCES_A), list(P.DISTRICTS_A)))
def parse_city(t):
    x = F.col("t")
    return cleaned(t).select("id", P.hinted(x, P.PROVINCES_A).alias("il"), P.hinted(x, P.DISTRICTS_A).alias("ilce"))


@query("WITH {P} SELECT id, nullif(regexp_extract(t, '(?:^| )([a-z]+) (izmir|ankara|bursa)$', 2), '') AS il, nullif(regexp_extract(t, '(?:^| )([a-z]+) (izmir|ankara|bursa)$', 1), '') AS ilce FROM clean")
def city_tail(t):
    il, ilce = P.tail_city(F.split("t", " "), ("izmir", "ankara", "bursa"))
    return cleaned(t).select("id", il.alias("il"), ilce.alias("ilce"))


#: All ten components, each lacking in some rows, in words that both dialects know.
COMPOSED = {
    "mahalle": "CASE WHEN id % 5 > 0 THEN 'ataturk' END",
    "cadde": "CASE WHEN id % 7 > 2 THEN concat('cadde ', id % 11) END",
    "sokak": "CASE WHEN id % 3 > 0 THEN cast(id % 500 + 1000 AS varchar(9)) END",
    "no": "CASE WHEN id % 13 > 1 THEN cast(id % 97 + 1 AS varchar(9)) END",
    "daire": "CASE WHEN id % 2 = 0 THEN cast(id % 9 + 1 AS varchar(9)) END",
    "kat": "CASE WHEN id % 6 > 3 THEN '2' END",
    "bina_adi": "CASE WHEN id % 4 = 1 THEN 'gul apartman' END",
    "mevkii": "CASE WHEN id % 4 = 0 THEN 'cinar' END",
    "il": "CASE WHEN id % 8 > 1 THEN 'izmir' END",
    "ilce": "CASE WHEN id % 9 > 4 THEN 'konak' END",
}
FOUND = "{P}, f AS (SELECT id, t, " + ", ".join(f"{v} AS {k}" for k, v in COMPOSED.items()) + " FROM clean)"


def composed_parts(t) -> DataFrame:
    return cleaned(t).select("id", "t", F.struct(*(F.expr(v).alias(k) for k, v in COMPOSED.items())).alias("p"))


def _named(order, form: str) -> str:
    return ", ".join(form.replace("NAME", name).replace("KEY", key) for name, key in order)


SHOWN = [(n, k) for n, k in P.SHOWN]
SIGNED = [(dict((k, n) for n, k in P.SHOWN)[k], k) for k in P.SIGNED]
PRESENT = " + ".join(f"({k} IS NOT NULL)::INT" for k in P.PARTS)
TEXT_SQL = f"concat_ws(' | ', {_named(SHOWN, chr(39) + 'NAME:' + chr(39) + ' || KEY')})"
JSON_SQL = "'{' || concat_ws(',', " + _named(SHOWN, "'\"NAME\":\"' || KEY || '\"'") + ") || '}'"


@query(f"WITH {FOUND} SELECT id, round(least(1.0, 0.2 * ({PRESENT}) + 0.2 * (no IS NOT NULL)::INT + 0.2 * (coalesce(mahalle, cadde, sokak) IS NOT NULL)::INT), 2) AS a, round(least(1.0, 0.15 * ({PRESENT}) + 0.15 * (no IS NOT NULL)::INT + 0.2 * (coalesce(mahalle, cadde, sokak) IS NOT NULL)::INT), 2) AS c FROM f")
def parse_confidence(t):
    parts = {k: F.col(f"p.{k}") for k in P.PARTS}
    return composed_parts(t).select("id", P.confidence(parts, 0.2).alias("a"), P.confidence(parts, 0.15).alias("c"))


@query(f"WITH {FOUND} SELECT id, {TEXT_SQL} AS shown FROM f")
def parts_string(t):
    return composed_parts(t).select("id", P.parts_text(F.col("p")).alias("shown"))


@query(f"WITH {FOUND} SELECT id, {JSON_SQL} AS shown FROM f")
def parts_json(t):
    return composed_parts(t).select("id", P.parts_json(F.col("p")).alias("shown"))


@query(f"WITH {FOUND} SELECT id, t || ' | ' || concat_ws(' ', {_named(SIGNED, chr(39) + 'NAME:' + chr(39) + ' || KEY')}) AS signature FROM f")
def signature(t):
    return composed_parts(t).select("id", P.signature(F.col("t"), F.col("p")).alias("signature"))


@query(f"WITH {FOUND} SELECT id, ' ' || concat_ws(' ', {', '.join(P.PARTS)}) AS side FROM f")
def side_text(t):
    return composed_parts(t).select("id", P.side_text(F.col("p")).alias("side"))


@query(f"WITH {FOUND} SELECT id, t AS normalized, {JSON_SQL} AS parts_json, {TEXT_SQL} AS parts_string FROM f")
def prediction_modes(t):
    return composed_parts(t).select("id", *(P.prediction(F.col("t"), F.col("p"), m).alias(m) for m in ("normalized", "parts_json", "parts_string")))


@query("WITH {P} SELECT id, regexp_extract(t, '^(.*) mahalle', 1) AS before, nullif(trim(regexp_extract(t, 'mahalle ([a-z ]+?) cadde', 1)), '') AS after FROM clean")
def postprocess_window(t):
    before, after = P.window(F.split("t", " "), "mahalle", False)
    return cleaned(t).select("id", before.alias("before"), after.alias("after"))


@query("WITH {P} SELECT id, pos, token, CASE WHEN token IN ('ataturk', 'building') THEN 'B-MAHALLE' WHEN token IN ('konak', 'merkez') THEN 'B-ILCE' WHEN token IN ('ankara', 'bursa', 'konak') THEN 'B-IL' ELSE 'O' END AS tag FROM (SELECT id, unnest(string_split(t, ' ')) AS token, unnest(range(len(string_split(t, ' ')))) AS pos FROM clean)")
def weak_labels(t):
    df = cleaned(t).select("id", F.split("t", " ").alias("w")).withColumn("g", P.weak_labels(F.col("w"), ("ataturk", "building"), ("ankara", "bursa", "konak"), ("konak", "merkez")))
    return df.select("id", F.posexplode(F.arrays_zip("w", "g")).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.col("x.w").alias("token"), F.col("x.g").alias("tag"))


def _struct(df: DataFrame, parts) -> DataFrame:
    return T.once(df, "p", parts).select("id", "t", "p.*")


@query()
def parse_a(t):
    return _struct(T.once(addresses(t), "t", P.clean_a(F.col("text"))), P.parse_a(F.col("t")))


@query()
def parse_a_post(t):
    df = T.once(T.once(addresses(t), "t", P.clean_a(F.col("text"))), "a", P.parse_a(F.col("t")))
    return T.once(df, "p", P.repair(F.col("t"), F.col("a"), P.PROVINCES_C)).select("id", "t", "p.*")


@query()
def parse_b(t):
    return _struct(T.once(addresses(t), "t", B.clean_b(F.col("text"))), B.parse_b(F.col("t")))


#: Without marks or digits side by side, both token normalizers come to this; I gives ı.
EXPANDED = "replace(replace(regexp_replace(trim(replace(lower(replace(text, 'I', 'ı')), ':', ' ')), ' +', ' ', 'g'), 'mah.', 'mahalle'), 'cad.', 'caddesi')"


# one nation's composed name ends in cd, which only this list of words expands
@query("WITH {A} SELECT id, replace(%s, ' cd ', ' caddesi ') AS out FROM addr" % EXPANDED)
def norm_tokens(t):
    return addresses(t).select("id", F.array_join(T.address_tokens(F.col("text")), " ").alias("out"))


@query("WITH {A} SELECT id, %s AS out FROM addr" % EXPANDED)
def norm_inline(t):
    return addresses(t).select("id", T.normalize_inline(F.col("text")).alias("out"))


@query()
def parse_c(t):
    return _struct(T.once(addresses(t), "t", P.clean_c(F.col("text"))), P.parse_c(F.col("t")))


FLAGGED = "SELECT doc_id, length(text) AS char_len, len(regexp_extract_all(text, '[^\\s]+')) AS word_len, len(regexp_extract_all(text, '[0-9]')) AS digit_count, len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) AS punct_count, text FROM documents"
BAD = "(char_len < 10 OR word_len < 2 OR char_len > 180 OR digit_count = 0)"


@query(f"SELECT doc_id, char_len, word_len, digit_count, punct_count, {BAD}::INT AS is_suspicious, (count(*) OVER (PARTITION BY text) > 1)::INT AS is_duplicate FROM ({FLAGGED})")
def quality_flags(t):
    df = t("documents").select("doc_id", "text", *(v.alias(k) for k, v in Q.flags(F.col("text")).items()))
    return Q.copies(df, "text").withColumn("is_duplicate", (F.col("copies") > 1).cast("int")).drop("text", "copies")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '^[\\s!-/:-@\\[-`{-~]*$') AND length(text) >= 6")
def clean_filter(t):
    return t("documents").where(Q.usable(F.col("text"))).select("doc_id")


@query("SELECT DISTINCT text, lang FROM documents")
def dedupe_exact(t):
    return t("documents").select("text", "lang").dropDuplicates()


@query("SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)")
def dedupe_clean(t):
    kept = Q.first_of(t("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")
    return positions(kept, "doc_id", "id").select("id", "doc_id")


@query(f"SELECT doc_id, 1 AS confidence_flag, 0.5::DOUBLE AS sample_weight FROM ({FLAGGED}) WHERE {BAD}")
def suspicious_rows(t):
    df = t("documents").select("doc_id", *(v.alias(k) for k, v in Q.flags(F.col("text")).items()))
    return Q.routed(df)[1].select("doc_id", F.lit(1).alias("confidence_flag"), F.lit(0.5).alias("sample_weight"))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT text) AS n_texts, count(*) FILTER (length(text) >= 6) AS n_long, count(*) FILTER {BAD.replace('(char_len', '(WHERE char_len')} AS n_suspicious FROM ({FLAGGED})".replace("FILTER (length", "FILTER (WHERE length"))
def lowconf_report(t):
    f = Q.flags(F.col("text"))
    return t("documents").select("text", f["is_suspicious"].alias("s")).agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_texts"), F.count_if(F.length("text") >= 6).alias("n_long"), F.sum("s").alias("n_suspicious"))


@query("SELECT column_name, missing, round(100.0 * missing / n, 3) AS missing_pct FROM (SELECT count(*) AS n, unnest(['doc_id', 'text', 'lang']) AS column_name, unnest([count(*) - count(doc_id), count(*) - count(text), count(*) - count(lang)]) AS missing FROM documents)")
def missing_report(t):
    return R.missing(t("documents").select("doc_id", "text", "lang"))


@query("SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS max FROM documents")
def length_describe(t):
    return R.describe(t("documents"), "n_chars")


@query("SELECT low, high, count(n_chars) AS n FROM (SELECT unnest([0, 100, 1000, 5000, 10000])::BIGINT AS low, unnest([100, 1000, 5000, 10000, 1000000])::BIGINT AS high) LEFT JOIN documents ON n_chars > low AND n_chars <= high GROUP BY low, high")
def length_bins(t):
    return R.bins(t("documents"), "n_chars", (0, 100, 1000, 5000, 10000, 1000000))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def label_counts(t):
    return R.counts(t("part"), "p_type")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_labels(t):
    return R.counts(t("part"), "p_brand", 10)


@query("SELECT count(*) AS n_values, sum(c)::BIGINT AS n_rows, round(1 - sum(c * c)::DOUBLE / (sum(c) * sum(c))::DOUBLE, 6) AS diversity FROM (SELECT count(*) AS c FROM part GROUP BY p_type)")
def label_diversity(t):
    return R.diversity(t("part"), "p_type")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1) ORDER BY o_orderkey LIMIT 20")
def head_labels(t):
    top = R.counts(t("orders"), "o_orderpriority", 1).select("o_orderpriority")
    return t("orders").join(F.broadcast(top), "o_orderpriority", "left_semi").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(20)


@query("SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1 ORDER BY n DESC, doc_id LIMIT 50")
def duplicates(t):
    return Q.copies(t("documents").select("doc_id", "text"), "text", "n").where("n > 1").select("doc_id", "n").orderBy(F.desc("n"), "doc_id").limit(50)


#: Fixed value: words that address profiles count.
TOKENS = ("mahalle", "mah", "mh", "cadde", "cad", "cd", "sokak", "sok", "sk", "bulvar", "blv", "no", "no.", "kat", "daire", "d:", "ap", "apt", "apartman", "sitesi", "blok", "bina", "mevkii", "caddesi", "sokağı", "sokagi")


@query("WITH {A} SELECT token, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b' || replace(token, '.', '\\.') || '\\b')) AS n FROM addr CROSS JOIN (SELECT unnest(%s) AS token) GROUP BY token" % list(TOKENS))
def token_presence(t):
    return R.presence(addresses(t), "text", TOKENS)


@query("WITH {A} SELECT count(*) FILTER (WHERE regexp_matches(text, '\\bmah\\.')) AS dotted, count(*) FILTER (WHERE regexp_matches(text, '\\bmahalle\\b')) AS written, round(avg((list_contains(string_split(text, ' '), 'sokak'))::INT), 6) AS coverage FROM addr")
def variant_counts(t):
    x = F.col("text")
    return addresses(t).agg(F.count_if(x.rlike(r"\bmah\.")).alias("dotted"), F.count_if(x.rlike(r"\bmahalle\b")).alias("written"), F.round(F.avg(F.array_contains(F.split(x, " "), "sokak").cast("int")), 6).alias("coverage"))


@query("SELECT doc_id, " + ", ".join(f"round(len(regexp_extract_all(text, '{p}'))::DOUBLE / length(text), 6) AS {n}" for n, p in (("digits", "[0-9]"), ("letters", "[A-Za-z]"), ("blanks", "[ \\n\\t\\r]"), ("punctuation", "[!-/:-@\\[-`{-~]"))) + " FROM documents")
def char_profile(t):
    return R.characters(t("documents"), "doc_id", "text")


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS gram FROM documents) GROUP BY gram")
def unigrams(t):
    return R.ngrams(t("documents"), "text", 1)


def _grams(n: int) -> str:
    return "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - %d), lambda i: concat_ws(' ', %s))) AS gram FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) GROUP BY gram" % (n - 2, ", ".join(f"w[i + {j}]" for j in range(n)))


@query(_grams(2))
def bigrams(t):
    return R.ngrams(t("documents"), "text", 2)


@query(_grams(3))
def trigrams(t):
    return R.ngrams(t("documents"), "text", 3)


@query("WITH {A}, g AS (SELECT id, row_number() OVER (ORDER BY id) AS p, list_distinct(list_transform(range(1, length(replace(text, ' ', '')) - 1), lambda i: substr(replace(text, ' ', ''), i, 3))) AS g FROM addr) SELECT i, j, round(s, 6) AS similarity FROM (SELECT a.id AS i, b.id AS j, len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM g a JOIN g b ON b.p > a.p AND b.p < a.p + 200) WHERE s >= 0.9")
def near_dup_jaccard(t):
    return R.near_positions(addresses(t), "id", "text", 200, 0.9)


def _tfidf_sql(terms: str, source: str, key: str) -> str:
    return f"WITH t AS (SELECT {key} AS id, unnest({terms}) AS term FROM {source}), c AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t GROUP BY id, term), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS docs FROM {source}), w AS (SELECT id, c.term, tf * (ln((1.0 + docs) / (1 + df)) + 1) AS w FROM c JOIN d USING (term), n), v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"


WORD_SQL, CHAR_SQL = "regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')", "list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3))"


def parts(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("label"))


@query(_tfidf_sql(WORD_SQL, "part", "p_partkey") + " SELECT id, term, round(weight, 6) AS weight FROM v")
def tfidf_word(t):
    return V.tfidf(parts(t), V.word_terms(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query(_tfidf_sql(CHAR_SQL, "part", "p_partkey") + " SELECT id, term, round(weight, 6) AS weight FROM v")
def tfidf_char(t):
    return V.tfidf(parts(t), V.char_terms(F.col("text"), 3, 3)).withColumn("weight", F.round("weight", 6))


@query("WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS found_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT * FROM (SELECT query_id, found_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, found_id)::INT AS rank FROM s) WHERE rank <= 3")
def knn_embeddings(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.dense_neighbours(v.where("id % 50 = 0"), v, 3)


@query(_tfidf_sql(WORD_SQL, "part", "p_partkey") + ", s AS (SELECT q.id AS query_id, v.id AS found_id, round(sum(q.weight * v.weight), 6) AS similarity FROM v q JOIN v ON q.term = v.term AND q.id <> v.id WHERE q.id % 50 = 0 GROUP BY ALL), m AS (SELECT query_id, max(similarity) AS similarity FROM s GROUP BY query_id) SELECT query_id, similarity FROM m")
def knn_tfidf(t):
    hits = V.text_neighbours(parts(t), V.word_terms, F.col("id") % 50 == 0, F.lit(True), 5).where("query_id <> found_id")
    return hits.groupBy("query_id").agg(F.max("similarity").alias("similarity"))


@query("SELECT count(*) AS n, round(avg((toxic = quality)::INT), 6) AS accuracy, round(2.0 * count(*) FILTER (WHERE toxic = 1 AND quality = 1) / (count(*) FILTER (WHERE toxic = 1) + count(*) FILTER (WHERE quality = 1)), 6) AS f1 FROM labels")
def eval_binary(t):
    return M.binary(t("labels"), "toxic", "quality")


PRED = "SELECT o_orderpriority AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '1-URGENT' END AS g FROM orders"


@query(f"WITH p AS ({PRED}), c AS (SELECT DISTINCT unnest([t, g]) AS c FROM p), x AS (SELECT c, count(*) FILTER (WHERE t = c) AS t, count(*) FILTER (WHERE g = c) AS g, count(*) FILTER (WHERE t = c AND g = c) AS h FROM c, p GROUP BY c), f AS (SELECT t, h, coalesce(2.0::DOUBLE * h / nullif(t + g, 0), 0) AS f1, coalesce(5.0::DOUBLE * h / nullif(4 * t + g, 0), 0) AS f2 FROM x) SELECT round(sum(h)::DOUBLE / sum(t)::DOUBLE, 4) AS accuracy, round(avg(f1), 4) AS macro_f1, round(avg(f2), 4) AS macro_f2, round(sum(h)::DOUBLE / sum(t)::DOUBLE, 4) AS micro_f1, round(sum(h)::DOUBLE / sum(t)::DOUBLE, 4) AS micro_f2, round(sum(f1 * t) / sum(t), 4) AS weighted_f1, round(sum(f2 * t) / sum(t), 4) AS weighted_f2 FROM f")
def eval_multiclass_f(t):
    o = t("orders").select(F.col("o_orderpriority").alias("t"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("1-URGENT").alias("g"))
    return M.multiclass(o, "t", "g")


@query(
    "WITH s AS (SELECT c_custkey, c_nationkey % 5 AS truth, k, (c_custkey * (k + 3) * 7919) % 1009 AS score FROM customer, (SELECT unnest(range(0, 5)) AS k)),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, k) AS place FROM s)"
    " SELECT count(DISTINCT c_custkey) AS n, round(count(*) FILTER (k = truth AND place <= 3)::DOUBLE / count(DISTINCT c_custkey), 6) AS accuracy FROM r"
)
def eval_top3(t):
    scores = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("c_custkey") * (k + 3) * 7919) % 1009)
    return M.top_k(t("customer").select((F.col("c_nationkey") % 5).alias("truth"), scores.alias("scores")), "truth", "scores")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1) % 3)::INT AS fold FROM orders")
def cv_folds(t):
    return M.folds(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 3).select("o_orderkey", "fold")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS held FROM orders")
def stratified_split(t):
    return M.held_out(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.2).select("o_orderkey", "held")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def hash_sample(t):
    return t("documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(100)


@query(f"WITH {TOP} SELECT left_id AS id, right_id AS match_id, score FROM m WHERE n = 1")
def submission_match(t):
    return linked(t, 1).select(F.col("left_id").alias("id"), F.col("right_id").alias("match_id"), "score")


@query("SELECT p_partkey AS id, dense_rank() OVER (ORDER BY p_type) - 1 AS label FROM part")
def submission_label(t):
    types = t("part").select("p_type").distinct()
    from pyspark.sql import Window

    coded = types.select("p_type", (F.row_number().over(Window.orderBy("p_type")) - 1).cast("long").alias("label"))
    return t("part").join(coded, "p_type").select(F.col("p_partkey").alias("id"), "label")


@query("WITH {A} SELECT id, '' AS note, text FROM addr")
def submission_template(t):
    return files.shaped(addresses(t), ["id", "note", "text"])
