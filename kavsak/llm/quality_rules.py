"""Quality rules combined by weak supervision, with DataFrame functions only.

Each rule votes to keep (1) or reject (-1) a document or abstains (0). Passing a check that nearly all texts pass is no
sign of quality, so most rules only reject or abstain; rules that measure the same thing vote as one. Expectation-
maximisation over the counts of vote patterns (at most 3^rules of them, whatever the input) estimates how often each rule
casts which vote on good and on bad documents, and the share of good ones; an abstention says nothing. Each rule begins
with, and is held near, the belief that four of five of its votes are right: ``trust`` imagined votes, a share of all
documents, stand for that. The posterior probability of being good then decides in place of all-must-pass.

Null texts count as empty: no words, so they fail the base rule (fewer than ``min_words``). Repeated rows vote alike and
all count. Extra columns pass through in ``keep`` and are ignored in ``score``. With an empty table, nothing is learned
and nothing returned. A document on which all rules abstain has the prior probability, and so stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, word_array

MIN_WORDS, MAX_REPEAT = 50, 50
#: Share of good documents to begin with; imagined votes of a rule, as a share of all documents.
PRIOR, TRUST = 0.85, 0.02
#: Frequent words of the languages met in the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "was", "der", "die", "das", "und", "von", "den", "mit", "ist", "le", "la", "les", "de", "des", "et", "un", "en", "que", "el", "los", "y", "se", "du")


def measured(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``_kv_q``, a struct of measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({"_kv_w": word_array("text"), "_kv_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w = F.col("_kv_w")
    df = df.withColumn("_kv_h", F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    grams = F.transform("_kv_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    # only texts in which a window repeats need them in order
    df = df.withColumn("_kv_g", F.when(F.size(F.array_distinct("_kv_h")) < F.size("_kv_h"), F.sort_array(grams)).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")))
    g = F.col("_kv_g")
    twice = F.filter(g, lambda x, i: F.coalesce(x.h == F.get(g, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(g, i + 1).h, F.lit(False)))
    df = df.withColumn("_kv_p", F.sort_array(F.transform(twice, lambda x: x.i)))
    p = F.col("_kv_p")
    repeat = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    measures = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long"),
        "n_lines": F.size("_kv_l"),
        "n_dup_lines": (F.size("_kv_l") - F.size(F.array_distinct("_kv_l"))).cast("long"),
        "n_repeat_words": repeat,
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_marks": F.length(F.regexp_replace(text, r"[^!?]++", "")),
        "n_digits": F.length(F.regexp_replace(text, r"[^0-9]++", "")),
        "n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
    }
    df = df.withColumn("_kv_m", F.struct(*(v.alias(k) for k, v in measures.items())))
    # one row each through a generator: the optimizer doesn't copy the measures into the filters and votes above it
    return df.select("*", F.explode(F.array("_kv_m")).alias("_kv_q")).drop("_kv_w", "_kv_l", "_kv_h", "_kv_g", "_kv_p", "_kv_m")


def rules(q: str = "_kv_q") -> dict[str, Column]:
    """Votes: each compares shares with its limits."""
    c = lambda x: F.col(f"{q}.{x}")
    share = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    reject = lambda x: F.when(x, -1).otherwise(0)
    mean, stops = share("word_chars", "n_words"), share("n_stop", "n_words")
    return {
        "symbols": reject(share("n_symbols", "n_words") >= 0.10),
        "repetition": reject((share("n_dup_lines", "n_lines") >= 0.30) | (share("n_repeat_words", "n_words") >= 0.30)),
        "shouting": reject((share("n_upper", "word_chars") >= 0.30) | (share("n_marks", "n_words") >= 0.20)),
        "digits": reject(share("n_digits", "word_chars") >= 0.20),
        "word_length": F.when((mean < 2.5) | (mean > 14), -1).when(mean.between(4, 9), 1).otherwise(0),
        "stop_words": F.when(stops < 0.02, -1).when(stops > 0.08, 1).otherwise(0),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = PRIOR, right: float = 0.8, trust: float = TRUST) -> tuple[float, list[dict[int, float]]]:
    """Share of good documents, and for each rule the log-odds that a vote of -1, 0 or 1 adds."""
    if not patterns:
        return prior, []
    n, total, start = len(patterns[0][0]), sum(c for _, c in patterns), prior
    ghost = trust * total
    chance = [[{1: right, 0: 1.0, -1: 1 - right}, {1: 1 - right, 0: 1.0, -1: right}] for _ in range(n)]
    belief = [{v: p / sum(side.values()) for v, p in side.items()} for side in chance[0]]
    rate = [[dict(side) for side in belief] for _ in range(n)]
    for _ in range(rounds):
        add = [{v: math.log(g[v] / b[v]) for v in (-1, 0, 1)} for g, b in rate]
        odds = math.log(prior / (1 - prior))
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(a[v] for a, v in zip(add, vote)))))) for vote, _ in patterns]
        mass = sum(p * c for p, (_, c) in zip(good, patterns))
        before, prior = prior, (mass + ghost * start) / (total + ghost)
        for i in range(n):
            for k, (weight, all_) in enumerate(((lambda p: p, mass), (lambda p: 1 - p, total - mass))):
                seen = {v: sum(weight(p) * c for p, (vote, c) in zip(good, patterns) if vote[i] == v) for v in (-1, 0, 1)}
                rate[i][k] = {v: (x + ghost * belief[k][v]) / (all_ + ghost) for v, x in seen.items()}
        if abs(prior - before) < 1e-12:
            break
    add = [{v: math.log(g[v] / b[v]) for v in (-1, 0, 1)} for g, b in rate]
    # a rule is better than chance: a vote to keep never counts against a document, nor one to reject for it
    return prior, [{-1: min(a[-1], 0.0), 0: a[0], 1: max(a[1], 0.0)} for a in add]


def learn(df: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """Fit on the vote patterns of all rows; the collected table has 3^rules rows at most."""
    votes = rules()
    rows = df.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).count().collect()
    return fit(sorted((tuple(r[k] for k in votes), r["count"]) for r in rows))


def posterior(model: tuple[float, list[dict[int, float]]]) -> Column:
    prior, add = model
    odds = F.lit(math.log(prior / (1 - prior)))
    for vote, a in zip(rules().values(), add):
        odds = odds + F.when(vote == 1, a[1]).when(vote == -1, a[-1]).otherwise(a[0])
    return 1 / (1 + F.exp(-odds))


def _base_failed() -> Column:
    return (F.col("_kv_q.n_words") < MIN_WORDS) | (100 * F.col("_kv_q.n_repeat_words") > MAX_REPEAT * F.col("_kv_q.n_words"))


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base measures, base_failed, p_good and kept."""
    df = materialise(measured(docs.select("doc_id", "text")).select("doc_id", "_kv_q"))
    df = df.select("doc_id", "_kv_q", posterior(learn(df)).alias("p_good"), _base_failed().alias("base_failed"))
    return df.select("doc_id", *(f"_kv_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns. Rows are written with their measures, which are taken once."""
    df = materialise(measured(docs))
    return df.where(~_base_failed() & (posterior(learn(df)) >= 0.5)).drop("_kv_q")
