"""Quality scores by Bradley-Terry ranking.

A document's worth is linear in features of its text. Preference pairs join each labelled poor document with ``pairs``
good ones (and, if good ones are fewer, the other way round); the weights minimise the logistic loss of the feature
differences. The threshold is a quantile of the worths of labelled documents: of the share of poor labels, moved to the
nearest gap where the two classes part best. Scores are a logistic curve about it.

Learning takes at most ``most_docs`` labelled texts of each class, by hash of doc_id, and whole texts of them until
``most_tokens`` are reached. Null and empty texts have zero features. A document labelled more than once counts as good if
any label says so. Repeated rows score alike. Rows with a null doc_id aren't learned from. Extra columns are ignored. With
no labels of a class, every score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from .toxicity import packed, sample, share_of

MOST_DOCS, MOST_TOKENS, PAIRS = 6000, 4_000_000, 8
UPPER, DIGIT, MARK, SYMBOL, LETTER = (np.array([chr(b) in s for b in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "#*$%&|<>{}[]\\^~=_@", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
LETTER[128:] = True
NAMES = ("words", "word_length", "upper", "digits", "marks", "symbols", "letters", "stops", "line_words", "dup_lines", "dup_grams", "kinds", "upper_words", "long_words", "symbol_words", "short")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of NAMES a document; shares go through a square root, which spreads small ones."""
    m = len(off) - 1
    starts, ends, first = T.words(data, off)
    n = np.diff(first).astype(float)
    n1 = np.maximum(n, 1)
    doc = np.repeat(np.arange(m), np.diff(first))
    size = np.maximum(np.diff(off), 1).astype(float)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag, dtype=np.int64))
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    def per_word(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag, dtype=np.int64))
        return total[ends] - total[starts]

    length = ends - starts
    chars = np.maximum(np.bincount(doc, length, m), 1)
    h = T.word_hash(data, starts, ends)

    def repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many of a document's keys equal an earlier one."""
        x = T.mix(keys ^ T.mix(owner.astype(np.uint64)))
        _, seen = np.unique(x, return_index=True)
        return np.bincount(owner, minlength=m) - np.bincount(owner[seen], minlength=m)

    # lines: runs between line ends, hashed whole
    cut = data == 10
    cut_off = np.flatnonzero(cut)
    line_start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], cut_off[cut_off + 1 < len(data)] + 1])).astype(np.int64)
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_doc = np.searchsorted(off, line_start, "right") - 1
    held = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[held], line_end[held], line_doc[held]
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) if len(line_end) else line_end
    lines = np.maximum(np.bincount(line_doc, minlength=m), 1)
    dup_lines = repeats(T.word_hash(data, line_start, line_end), line_doc) if len(line_start) else np.zeros(m)
    grams = T.gram_hash(h, 3)
    inside = doc[: len(grams)] == doc[2:] if len(grams) else np.zeros(0, bool)
    dup_grams = repeats(grams[inside], doc[: len(grams)][inside]) if len(grams) else np.zeros(m)
    upper, symbols = per_word(UPPER[data]), per_word(SYMBOL[data])
    root = lambda x: np.sqrt(np.clip(x, 0, 1))
    share = lambda flag: np.bincount(doc, flag, m) / n1
    out = [
        np.log1p(n) / 5,
        np.minimum(chars / n1, 30) / 10,
        root(per_doc(UPPER[data]) / chars),
        root(per_doc(DIGIT[data]) / chars),
        root(per_doc(MARK[data]) / n1),
        root(per_doc(SYMBOL[data]) / n1),
        per_doc(LETTER[data]) / size,
        share(length <= 3),
        np.log1p(n / lines) / 4,
        root(dup_lines / lines),
        root(dup_grams / n1),
        1 - np.bincount(doc, minlength=m) / n1 + (n - repeats(h, doc)) / n1,
        share((upper >= 2) & (upper * 2 >= length)),
        share(length > 20),
        share(symbols > 0),
        (n < 30).astype(float),
    ]
    return np.column_stack(out)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights from pairs, the threshold among the worths, and the curve's width."""
    rng = np.random.default_rng(seed)
    good, poor = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    a, b = (np.tile(good, pairs), rng.choice(poor, len(good) * pairs)) if len(good) < len(poor) else (rng.choice(good, len(poor) * pairs), np.tile(poor, pairs))
    scale = x.std(0) + 1e-6
    diff = (x[a] - x[b]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(0) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    return w, *threshold(x @ w, y)


def threshold(worth: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The quantile of the share of poor documents, moved within a tenth of the ranks to where fewest are misplaced."""
    order = np.argsort(worth, kind="stable")
    poor = int((y <= 0).sum())
    wrong = np.append(0, np.cumsum(y[order] > 0)) + (poor - np.append(0, np.cumsum(y[order] <= 0)))
    near = max(1, len(y) // 10)
    lo, hi = max(1, poor - near), min(len(y) - 1, poor + near)
    cut = min(range(lo, hi + 1), key=lambda k: (wrong[k], abs(k - poor)))
    return float((worth[order[cut - 1]] + worth[order[cut]]) / 2), float(np.std(worth) + 1e-9)


def quality(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", most_docs: int = MOST_DOCS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, worth. ``held_out`` maps a doc_id column to a condition."""
    sc = docs.sparkSession.sparkContext
    rows = sample(docs, labels, label, held_out, most_docs, most_tokens)
    base = share_of(labels, label, held_out)
    y = np.array([r[0] for r in rows], float)
    model = None
    if 0 < y.sum() < len(y):
        x = np.concatenate([features(*packed([t for _, t, _ in rows[i : i + 500]])) for i in range(0, len(rows), 500)])
        w, cut, width = fit(x, y)
        # classes were sampled to equal sizes: the quantile is taken with their true shares
        keep = np.random.default_rng(3).random(len(y)) < np.where(y > 0, *((1.0, min(1.0, (1 - base) / base * y.sum() / (len(y) - y.sum()))) if base >= 0.5 else (min(1.0, base / (1 - base) * (len(y) - y.sum()) / y.sum()), 1.0)))
        if 0 < y[keep].sum() < keep.sum():
            cut, width = threshold(x[keep] @ w, y[keep])
        model = (w, cut, width)
    model = sc.broadcast(model)
    del rows

    def run(batches):
        m = model.value
        for part, data, off in T.chunks(batches):
            worth = features(data, off) @ m[0] if m else np.zeros(part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(4 * (worth - m[1]) / m[2], -500, 500))) if m else np.full(part.num_rows, base)
            yield pa.RecordBatch.from_arrays([T.column(part, "doc_id"), T.column(part, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(worth)], ["doc_id", "held_out", "score", "predicted", "worth"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worth double")
