"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model of token bigrams, and a toxic and an ordinary model of the bytes of tokens (order five), are
trained on labelled texts by interpolated Kneser-Ney smoothing: the highest order has the counts of its class less a
discount, lower orders the class's continuation counts (how many different histories an expression follows), and the lowest
backs off to counts that the classes share: each expression of either class counts once, unknown ones together like half a
one. Discounts follow from the counts of counts of each class and order. So an expression that is rare in a class rests
mostly on what the classes share. Ratios of single tokens and bytes within a floor of 0 count as 0, larger ones less the
floor: else the many expressions that happen to be a little more frequent in one class outweigh the few that tell. A text's
log-likelihood ratios, divided by its number of tokens, go through a logistic curve that is fitted on labelled texts kept
out of the counts; they also choose the floors and whether tokens are looked at in pairs or alone (by continuation counts).

Learning takes at most ``most_docs`` labelled texts of each class, by hash of doc_id, and of these, in that order, whole
texts until ``most_tokens`` are reached: that bounds what is collected and broadcast. Tokens are runs of ASCII letters,
digits and non-ASCII characters, in ASCII lower case; all bytes of a token are looked at, however long it is (a text
without blanks is one token). Null and empty texts have ratio 0. A document labelled more than
once counts as toxic if any label says so. Repeated rows score alike. Rows with a null doc_id aren't learned from. Extra
columns are ignored. With no labels of a class, every score is the share of toxic labels (0.5 without any).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

MOST_DOCS, MOST_TOKENS = 4000, 2_500_000
#: Share of the labelled sample that fits the curve; ratio at which small ones are told apart.
HELD, BEND = 4, 1e-3
#: Bytes of a gram within tokens; bytes of tokens whose grams are held at once (a longer token is worked on alone).
ORDER, SLICE = 5, 1 << 19
#: Shared count of what neither class knows.
UNKNOWN = 0.5
#: What the texts kept out choose from: tokens alone or in pairs, floors of the ratios of tokens and of bytes.
ORDERS, FLOORS, BYTE_FLOORS = (1, 2), (0.0, 1.0, 2.0, 3.0), (0.0, 1.0, 2.0)
_U = np.uint64
BREAK = np.array([not (chr(b).isalnum() and b < 128) and b < 128 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, each document's first token, and where tokens start and end."""
    starts, ends, first = T.words(data, off, BREAK)
    return T.word_hash(LOWER[data], starts, ends), first, starts, ends


def bigrams(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it in its document, and whether there is one."""
    has = np.ones(len(w), bool)
    has[first[:-1][np.diff(first) > 0]] = False
    before = np.concatenate([np.zeros(min(1, len(w)), _U), w[:-1]])
    return T.mix(before * _U(0x9E3779B97F4A7C15) ^ w), has


def _counted(keys: list[np.ndarray], times: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys of both classes, sorted, and how often each class has them."""
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    cut = len(keys[0])
    return every, [np.bincount(x, t, len(every)).astype(float) for x, t in zip((at[:cut], at[cut:]), times or (None, None))]


def _discount(counts: np.ndarray) -> float:
    """Ney's estimate from the numbers of counts of one and of two."""
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one else 0.5


def _level(counts: np.ndarray, of: np.ndarray, n: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities of grams in their histories ``of`` (n of them), and what each history leaves for others."""
    d = _discount(counts)
    total = np.bincount(of, counts, n)
    left = np.where(total > 0, d * np.bincount(of, counts > 0, n) / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / np.maximum(total[of], 1) + left[of] * lower, left


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is in the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def over(ratio: np.ndarray, floor: float) -> np.ndarray:
    """What a ratio is beyond the floor."""
    return np.sign(ratio) * np.maximum(np.abs(ratio) - floor, 0)


def mean(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means of tokens' values by document."""
    total = np.append(0.0, np.cumsum(x))
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)


class Bigrams:
    """Log-likelihood ratios of two classes' Kneser-Ney models of token bigrams."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        """docs: for the ordinary and for the toxic class, tokens and the first token of each document."""
        keys, held, words = [], [], []
        for w, first in docs:
            key, has = bigrams(w, first)
            keys.append(key[has])
            held.append(np.concatenate([w[:0], w[:-1][has[1:]]]))
            words.append(w[has])
        self.keys, counts = _counted(keys)
        where = np.unique(np.concatenate(keys), return_index=True)[1]
        self.vocab = np.unique(np.concatenate([w for w, _ in docs]))
        h, w = (np.searchsorted(self.vocab, np.concatenate(x)[where]) for x in (held, words))
        n = len(self.vocab)
        follows = [np.bincount(w, c > 0, n) for c in counts]
        shared, none = np.full(n, 1 / (n + UNKNOWN)), np.zeros(n, np.int64)
        uni, rest = zip(*(_level(c, none, 1, shared) for c in follows))
        two, after = zip(*(_level(c, h, n, u[w]) for c, u in zip(counts, uni)))
        log = lambda x: np.log(np.maximum(x, 1e-300))
        self.ratio = log(two[1]) - log(two[0])
        self.uni, self.after = log(uni[1]) - log(uni[0]), log(after[1]) - log(after[0])
        self.new = float(log(rest[1][0]) - log(rest[0][0])) if n else 0.0

    def ratios(self, w: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
        """The ratio of each token, after the one before it or alone."""
        at, known = _find(self.vocab, w)
        out, left = (np.where(known, x[at], y) for x, y in ((self.uni, self.new), (self.after, 0.0))) if len(self.vocab) else (np.zeros(len(w)),) * 2
        if order == 1:
            return out
        key, has = bigrams(w, first)
        out[1:] += np.where(has[1:], left[:-1], 0.0)
        at, seen = _find(self.keys, key)
        seen &= has
        out[seen] = self.ratio[at[seen]]
        return out


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ORDER bytes that end at each byte of the tokens and at their end, as numbers, and each one's token."""
    size = ends - starts
    total = size + ORDER
    first = np.cumsum(total) - total
    flat = np.zeros(int(total.sum()), np.uint8)
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    flat[first[owner] + ORDER - 1 + inner] = data[starts[owner] + inner]
    gram = np.zeros(len(owner) + len(size), _U)
    owner = np.repeat(np.arange(len(size)), size + 1)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    for k in range(ORDER):
        gram = gram << _U(8) | flat[at + k].astype(_U)
    return gram, owner


def sliced(starts: np.ndarray, ends: np.ndarray) -> list[slice]:
    """Stretches of tokens of about SLICE bytes each."""
    total = np.cumsum(ends - starts)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(SLICE, total[-1] if len(total) else 0, SLICE)) + 1, [len(starts)]]))
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of tokens, and how often they occur if each token occurs ``n`` times."""
    keys, times = [np.zeros(0, _U)], [np.zeros(0)]
    for part in sliced(starts, ends):
        g, owner = padded(data, starts[part], ends[part])
        every, at = np.unique(g, return_inverse=True)
        keys.append(every)
        times.append(np.bincount(at, n[part][owner], len(every)))
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(times), len(every))


class Bytes:
    """Log-likelihood ratios of two classes' Kneser-Ney models of the bytes of tokens."""

    def __init__(self, classes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        """classes: for the ordinary and for the toxic class, bytes, starts and ends of different tokens, and how often each occurs."""
        level = []
        keys, c = _counted(*map(list, zip(*(gathered(*x) for x in classes))))
        level.append((keys, c))
        for k in range(ORDER - 1, 0, -1):
            # a gram's continuation count: how many different bytes stand before it
            cut = _U((1 << 8 * k) - 1)
            keys, c = _counted([keys[x > 0] & cut for x in c])
            level.append((keys, c))
        self.levels = []
        for keys, c in reversed(level):
            held, of = np.unique(keys >> _U(8), return_inverse=True)
            stats = []
            for x in c:
                total, kinds = np.bincount(of, x, len(held)), np.bincount(of, x > 0, len(held))
                stats.append((x, _discount(x), total, kinds))
            self.levels.append((keys, held, stats))

    def ratio(self, grams: np.ndarray) -> np.ndarray:
        p = [np.full(len(grams), 1 / 256)] * 2
        for k, (keys, held, stats) in enumerate(self.levels, 1):
            g = grams & _U((1 << 8 * k) - 1)
            at, seen = _find(keys, g)
            of, known = _find(held, g >> _U(8))
            for c, (n, d, total, kinds) in enumerate(stats):
                t = np.where(known, total[of], 0)
                own = np.where(seen, np.maximum(n[at] - d, 0), 0)
                p[c] = np.where(t > 0, (own + d * kinds[of] * p[c]) / np.maximum(t, 1), p[c])
        return np.log(p[1]) - np.log(p[0])

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *floors: float) -> list[np.ndarray]:
        """The ratio of each token, for each floor."""
        out = [np.zeros(len(starts)) for _ in floors]
        for part in sliced(starts, ends):
            grams, owner = padded(data, starts[part], ends[part])
            different, at = np.unique(grams, return_inverse=True)
            one = self.ratio(different)[at]
            for x, floor in zip(out, floors):
                x[part] = np.bincount(owner, over(one, floor), part.stop - part.start)
        return out


class Scorer:
    """Both pairs of models, and the curve over their length-normalised ratios."""

    def __init__(self, classes: list[list[str]]):
        split, parts, vocab = [], [], []
        for texts in classes:
            data, off = packed(texts)
            w, first, starts, ends = tokens(data, off)
            split.append((w, first))
            every, where, n = np.unique(w, return_index=True, return_counts=True)
            parts.append((LOWER[data], starts[where], ends[where], n.astype(float)))
            vocab.append(every)
        self.pairs, self.bytes, self.parts, self.known = Bigrams(split), Bytes(parts), parts, vocab
        self.order, self.floor, self.curve, self.part = 1, 0.0, np.zeros(3), np.zeros(0)

    def settle(self, order: int, floor: float, byte_floor: float, curve: np.ndarray) -> None:
        """Take what the texts kept out chose, and note the byte models' ratios of all known tokens."""
        self.order, self.floor, self.byte_floor, self.curve = order, floor, byte_floor, curve
        first = np.unique(np.concatenate(self.known), return_index=True)[1]
        self.part = np.concatenate([self.bytes.ratios(*p[:3], byte_floor)[0] for p in self.parts])[first]
        del self.parts, self.known
        if order == 1:
            self.pairs.keys, self.pairs.ratio = self.pairs.keys[:0], self.pairs.ratio[:0]

    def ratios(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        w, first, starts, ends = tokens(data, off)
        at, known = _find(self.pairs.vocab, w)
        part = np.where(known, self.part[at], 0.0) if len(self.part) else np.zeros(len(w))
        new = np.flatnonzero(~known)
        if len(new):
            _, where, back = np.unique(w[new], return_index=True, return_inverse=True)
            part[new] = self.bytes.ratios(LOWER[data], starts[new][where], ends[new][where], self.byte_floor)[0][back]
        return np.column_stack([mean(over(self.pairs.ratios(w, first, self.order), self.floor), first), mean(part, first)])

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        """Small ratios are spread before the curve."""
        return 1 / (1 + np.exp(-np.clip(np.arcsinh(ratios / BEND) @ self.curve[:2] + self.curve[2], -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + l2 * np.append(beta[:-1], 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(np.append(np.full(len(beta) - 1, l2), 1e-9))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out, most_docs: int, most_tokens: int) -> list[tuple[int, str, int]]:
    """(label, text, number by hash) of the labelled texts to learn from; bounded by both limits."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("l_id")
    picked = None
    for y in (0, 1):
        part = labels.where(F.col("y") == y).orderBy(order, "l_id").limit(most_docs)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    sized = texts.groupBy("l_id", "y", "text").count().select("l_id", "y", (F.octet_length("text") / 4).alias("n"), F.xxhash64("l_id").alias("o"))
    got, chosen = {0: 0.0, 1: 0.0}, []
    for r in sorted(sized.collect(), key=lambda r: (r["o"], r["l_id"], r["n"])):
        if got[r["y"]] < most_tokens:
            got[r["y"]] += r["n"]
            chosen.append(r["l_id"])
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "c_id long")
    rows = texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("c_id"), "left_semi").select("y", "text", F.xxhash64("l_id").alias("o")).distinct().collect()
    return sorted(((r["y"], r["text"], r["o"]) for r in rows), key=lambda r: (r[2], r[0], r[1]))


def share_of(labels: DataFrame, label: str, held_out) -> float:
    """Share of ones among the labels to learn from."""
    r = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    return 0.5 if r is None else float(r)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def train(rows: list[tuple[int, str, int]], base: float) -> Scorer | float:
    """A model, or the share of toxic labels if a class is missing."""
    fit = [[t for y, t, o in rows if y == c and o % HELD] for c in (0, 1)]
    held = [(y, t) for y, t, o in rows if not o % HELD]
    if not all(any(tokens(*packed([t]))[0].size for t in f) for f in fit):
        return base
    if len({y for y, _ in held}) < 2:
        held = [(y, t) for y, t, _ in rows]
    y = np.array([y for y, _ in held], float)
    share = min(max(base, 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    model = Scorer(fit)
    data, off = packed([t for _, t in held])
    w, first, starts, ends = tokens(data, off)
    by_byte = [mean(x, first) for x in model.bytes.ratios(LOWER[data], starts, ends, *BYTE_FLOORS)]
    best, least = None, math.inf
    for order in ORDERS:
        one = model.pairs.ratios(w, first, order)
        for floor in FLOORS:
            by_token = mean(over(one, floor), first)
            for byte_floor, parts in zip(BYTE_FLOORS, by_byte):
                x = np.arcsinh(np.column_stack([by_token, parts]) / BEND)
                scale = np.maximum(x.std(0), 1e-9)
                curve = logistic(x / scale, y, weight) / np.append(scale, 1.0)
                z = (2 * y - 1) * (x @ curve[:2] + curve[2])
                if (loss := float((weight * np.logaddexp(0, -z)).sum())) < least - 1e-9:
                    best, least = (order, floor, byte_floor, curve), loss
    model.settle(*best)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", most_docs: int = MOST_DOCS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, token_ratio, byte_ratio. ``held_out`` maps a doc_id column to a condition."""
    sc = docs.sparkSession.sparkContext
    rows = sample(docs, labels, label, held_out, most_docs, most_tokens)
    model = sc.broadcast(train(rows, share_of(labels, label, held_out)))
    del rows

    def run(batches):
        m = model.value
        for part, data, off in T.chunks(batches):
            ratio = np.zeros((part.num_rows, 2)) if isinstance(m, float) else m.ratios(data, off)
            score = np.full(part.num_rows, m) if isinstance(m, float) else m.scores(ratio)
            yield pa.RecordBatch.from_arrays([T.column(part, "doc_id"), T.column(part, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(ratio[:, 0]), pa.array(ratio[:, 1])], ["doc_id", "held_out", "score", "predicted", "token_ratio", "byte_ratio"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, token_ratio double, byte_ratio double")
