"""What the command line does, as functions over files."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse as P
from .functions import text as T
from .operators import classify as C
from .operators import linkage as L
from .operators import metrics as M
from .operators import quality as Q
from .operators import retrieval as V
from .operators.ordinal import positions
from .sources import files


def settings(path: str | None) -> dict:
    """A YAML file as a mapping; a missing one is empty."""
    file = Path(path) if path else None
    return (yaml.safe_load(file.read_text(encoding="utf-8-sig")) or {}) if file and file.exists() else {}


def _side(df: DataFrame, key: str, text: str | None) -> DataFrame:
    column = files.text_column(df, text)
    return L.places(df).withColumns({"id": F.col(key), "text": T.tr_safe_lower(F.coalesce(F.col(column), F.lit("")))})


def match(spark: SparkSession, left: str, right: str, output: str, config: str | None = None) -> DataFrame:
    """Link two tables as configured; writes matches and, if asked for, the rows without one."""
    cfg = settings(config)
    sides = [files.read_csv(spark, p) for p in (left, right)]
    if any(df.isEmpty() for df in sides):
        out = spark.createDataFrame([], "left_id string, right_id string, score double")
        files.write_csv(out, output)
        return out
    a, b = (_side(df, str(cfg.get(f"{name}_id", "id")), cfg.get("text_col")) for df, name in zip(sides, ("left", "right")))
    if str(cfg.get("method", "fuzzy")).lower() == "index":
        place = lambda df, name: positions(df.select(F.monotonically_increasing_id().alias("_m"), F.col("id").alias(name)), "_m", "i").drop("_m")
        out = place(a, "left_id").join(place(b, "right_id"), "i").select("left_id", "right_id", F.lit(1.0).alias("score"))
    else:
        w = cfg.get("weights") or {}
        weights = tuple(float(w.get(k, d)) for k, d in (("text", 0.8), ("digits", 0.2), ("geo", 0.2)))
        stops = tuple(x.strip() for x in cfg.get("semantic_stopwords") or () if isinstance(x, str) and x.strip())
        pairs = L.candidates(a, b, str(cfg.get("block_by") or ""), stops, salt=8)
        found = L.scored(pairs, str(cfg.get("scorer", "token_set_ratio")).lower(), weights, L.threshold(cfg.get("threshold", 80)), float(cfg.get("geo_max_km", 1.5)))
        out = L.best(found, int(cfg.get("topk", 1))).select("left_id", "right_id", "score")
    files.write_csv(out, output)
    if cfg.get("write_unmatched", True):
        for df, name in ((a, "left"), (b, "right")):
            rest = L.unmatched(df.select("id", "text"), out, f"{name}_id")
            if not rest.isEmpty():
                files.write_csv(rest, f"{output}_unmatched_{name}")
    return out


def normalize(spark: SparkSession, source: str, output: str, config: str | None = None) -> DataFrame:
    return files.normalize_file(spark, source, output, config)


def clean(spark: SparkSession, source: str, output: str, drop_suspicious: bool = False) -> DataFrame:
    """Clean and parse addresses, flag rows, write those that are suspicious beside the rest."""
    df = T.hygiene(files.required(files.read_csv(spark, source), "id", "address", rows=True))
    df = T.once(df.withColumn("address", T.null_tokens(F.col("address"))), "address_clean", P.clean_c(F.col("address")))
    df = T.once(df, "_p", P.parse_c(F.col("address_clean")))
    flags = Q.flags(F.col("address_clean"))
    df = df.select("id", "address", "address_clean", *(F.col(f"_p.{k}").alias(k) for k in P.PARTS), F.col("_p.confidence").alias("_confidence"), *(v.alias(k) for k, v in flags.items()), *(c for c in ("label",) if c in df.columns))
    df = Q.copies(df, "address_clean").withColumn("is_duplicate_clean", (F.col("copies") > 1).cast("int")).drop("copies")
    kept, odd = Q.routed(df)
    files.write_csv(odd, f"{output}_suspicious")
    out = kept if drop_suspicious else df
    files.write_csv(out, output)
    return out


def knn(spark: SparkSession, train: str, test: str, output: str, limit: int | None = None) -> DataFrame:
    """The label of the nearest training address for each row; rows without a known word get the most frequent label."""
    a, b = (files.read_csv(spark, p, limit=limit) for p in (train, test))
    a = files.required(a, "address", "label", rows=True).withColumn("id", F.monotonically_increasing_id())
    b = files.required(b, "id", "address")
    text = lambda df: T.once(df, "text", T.array_text(F.col("address"))).select("id", "text").persist()
    terms = V.word_terms(F.col("text"), 2)
    docs = text(a)
    known = V.vocabulary(docs, V.term_counts(docs, terms), 2)
    index, queries = (V.tfidf(d, terms, known=known) for d in (docs, text(b)))
    near = V.transferred(V.neighbours(queries, index, 1), a.select("id", "label"))
    top = a.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    out = b.select("id").join(near, F.col("id") == F.col("query_id"), "left").select("id", F.coalesce("label", F.lit(top)).alias("label"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    files.write_csv(out.select("id", "label"), output)
    return out


def _channels(df: DataFrame) -> DataFrame:
    """id, base text and side text, cleaned and parsed here unless the table already is."""
    if "address_clean" not in df.columns:
        df = T.once(df, "address_clean", P.clean_c(F.col("address")))
    parts = P.parse_c(F.col("address_clean")) if not set(P.PARTS) <= set(df.columns) else F.struct(*P.PARTS)
    return T.once(df, "_p", parts).select("id", F.col("address_clean").alias("base"), P.side_text(F.col("_p")).alias("side"), *(c for c in ("label",) if c in df.columns))


def train(spark: SparkSession, source: str, test: str, output: str, model: str | None = None, folds: int = 3, channels=C.CHANNELS) -> dict[str, float]:
    """Cross-validate, fit on all rows, save the model, write the predictions; returns accuracy and top-3 accuracy."""
    files.set_seeds()
    rows = files.required(files.read_csv(spark, source), "address", "label", rows=True)
    rows = _channels(rows.withColumn("id", F.monotonically_increasing_id()) if "id" not in rows.columns else rows).persist()
    dealt, scores = M.folds(rows, "id", "label", folds).persist(), []
    for k in range(folds):
        fit, rest = dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k)
        features = C.Features(fit, channels)
        found = C.Classifier(features.of(fit).join(fit.select("id", "label"), "id"))
        place = F.array_position(F.array(*(F.lit(x) for x in found.labels.labels)), F.col("label").cast("string")).cast("int") - 1
        got = found.predict(features.of(rest).join(rest.select("id", "label"), "id")).withColumn("truth", place)
        got = got.select("predicted", "label", "truth", "probabilities").persist()
        hit = F.avg((F.col("predicted") == F.col("label")).cast("double"))
        scores.append((got.agg(hit).first()[0] or 0.0, M.top_k(got, "truth", "probabilities").first()["accuracy"] or 0.0))
    features = C.Features(rows, channels)
    found = C.Classifier(features.of(rows).join(rows.select("id", "label"), "id"))
    if model:
        found.save(model)
    queries = _channels(files.required(files.read_csv(spark, test), "id", "address"))
    files.write_csv(found.predict(features.of(queries)).select("id", F.col("predicted").alias("label")), output)
    return {"accuracy": sum(a for a, _ in scores) / folds, "top3": sum(b for _, b in scores) / folds}


def submit(spark: SparkSession, source: str, template: str, output: str, mode: str = "normalized") -> DataFrame:
    """Predictions in the shape of a template: its first column is the id, its last the prediction, others are blank."""
    columns = files.read_csv(spark, template).columns
    df = files.required(files.read_csv(spark, source), "id", "address")
    df = T.once(df, "_t", P.clean_a(F.col("address")))
    df = T.once(T.once(df, "_a", P.parse_a(F.col("_t"))), "_p", P.repair(F.col("_t"), F.col("_a"), P.PROVINCES_C))
    df = df.select(F.col("id").alias(columns[0]), P.prediction(F.col("_t"), F.col("_p"), mode).alias(columns[-1]))
    out = files.shaped(df, columns)
    files.write_csv(out, output)
    return out


def evaluate(spark: SparkSession, gold: str, pred: str) -> dict[str, float]:
    a, b = (files.required(files.read_csv(spark, p), "id", "match") for p in (gold, pred))
    pairs = M.paired(a, b).select(F.col("match_true").cast("int").alias("t"), F.col("match_pred").cast("int").alias("g"))
    r = M.binary(pairs, "t", "g").first()
    return {"n": r["n"], "accuracy": r["accuracy"], "f1": r["f1"]}


def score(spark: SparkSession, source: str, output: str) -> DataFrame:
    out = L.rescored(files.required(files.read_csv(spark, source), "score"))
    files.write_csv(out, output)
    return out


def build(spark: SparkSession, matches: str, output: str) -> DataFrame:
    """id, match_id and score of the matches."""
    df = files.required(files.read_csv(spark, matches), "left_id", "right_id", "score")
    out = df.select(F.col("left_id").alias("id"), F.col("right_id").alias("match_id"), "score")
    files.write_csv(out, output)
    return out
