"""Cross-entropy difference of a target and a background n-gram model.

Both models are bigram models of one form over one vocabulary: all words of all documents, however rare, and all bigrams,
those seen once included. They are counted exactly over all documents, for the background model all of them and for the
target model those of ``target_ids``. Bigram counts are discounted; the mass that this sets free goes to smoothed word
counts. When a document is scored, its own bigrams are taken from their counts first (leave one out), so target documents
don't profit from having been learned from. A document's score is the mean over its words of the target's loss less the
background's, in nats: the lower, the closer to the target.

Texts are packed in batches of about ``batch`` words: the batch's different words and, for each word of its texts, its
number among them. Each batch sends its words, and its different bigrams, as sorted lists to buckets: words by their hash,
bigrams by that of their first word (frequent first words are dealt to several buckets by the second word, so that no bucket
is hot). There all batches' counts are added up, and each list is answered by a list in the same order, which the batch is
scored with. A bucket has about ``pairs`` bigrams, so their number grows with the input and their size doesn't.

Words are case-sensitive runs of non-blanks, told apart by 64-bit hashes (in bigrams, second words by 48 bits). Null and
blank texts have no words and score 0. Repeated rows all count and score alike. Extra columns are ignored. With no target
document the two models are the same and all scores are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import materialise, small

DISCOUNT, ADD, BATCH, PAIRS = 0.75, 0.5, 1_250_000, 1_500_000
#: Target documents up to which their ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64
#: What stands before a document's first word.
START = _U(0x5851F42D4C957F2D)
PACKED = "g long, size long, words binary, tokens binary, sizes binary, ids array<long>, hits binary"
#: Lists of words to buckets (kind 2), what buckets know (0: words and counts; 1: of bigrams by first word) and answers.
LISTS = "bucket int, kind int, g long, words binary, n binary, m binary, kinds binary, kinds_m binary"
#: Lists of bigrams; answers have ``more``, a bit for each bigram that others have counted too, and how often.
PAIR_LISTS = "bucket int, g long, h binary, runs binary, w binary, n binary, m binary"
SCORES = "doc_id long, n_words long, target_loss double, background_loss double, ce_diff double"


def squeezed(x: np.ndarray) -> bytes:
    """Small numbers, byte by byte of their place value, compressed; their number comes first."""
    return len(x).to_bytes(8, "little") + pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _batch(arrays: dict, schema: str) -> pa.RecordBatch:
    """Columns in the order of the schema; those not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names = [c.split(" ") for c in schema.split(", ")]
    n = len(next(iter(arrays.values())))
    return pa.RecordBatch.from_arrays([pa.array(arrays[c], kinds[k]) if c in arrays else pa.nulls(n, kinds[k]) for c, k in names], [c for c, _ in names])


def pack(limit: int):
    """Batches of texts: their different words (START too), their words' numbers, texts' numbers of words, doc_ids, marks of targets."""

    def run(batches):
        held, size, row = [], 0, TaskContext.get().partitionId() << 33

        def out():
            w, sizes, ids, hits = (np.concatenate(x) for x in list(zip(*held)))
            words, at = np.unique(np.append(w, START), return_inverse=True)
            ids = [None if i is None else int(i) for i in ids]
            return _batch({"g": [row], "size": [len(w)], "words": [words.tobytes()], "tokens": [squeezed(at[:-1])], "sizes": [squeezed(sizes)], "ids": [ids], "hits": [hits.astype(np.uint8).tobytes()]}, PACKED)

        for rows, data, off in T.chunks(batches):
            starts, ends, first = T.words(data, off)
            held.append((T.word_hash(data, starts, ends), np.diff(first), np.array(T.column(rows, "doc_id").to_pylist(), object), T.column(rows, "hit").to_numpy(zero_copy_only=False)))
            size += len(starts)
            if size >= limit:
                yield out()
                held, size, row = [], 0, row + 1
        if held:
            yield out()

    return run


class Texts:
    """A batch of packed texts: words, and per word of the texts its number, its bigram and its text."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], _U)
        self.tokens, sizes = unsqueezed(row["tokens"]), unsqueezed(row["sizes"])
        self.hits = np.frombuffer(row["hits"], np.uint8)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.start = int(np.searchsorted(self.words, START))
        self.before = np.concatenate([self.tokens[:0], [self.start], self.tokens[:-1]])[: len(self.tokens)]
        self.before[self.first[:-1][sizes > 0]] = self.start
        self.hit = self.hits[self.text].astype(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each different word in all texts and in targets; of START, texts with words."""
        n, m = (np.bincount(self.tokens, x, len(self.words)).astype(np.int64) for x in (None, self.hit))
        some = np.diff(self.first) > 0
        n[self.start], m[self.start] = n[self.start] + some.sum(), m[self.start] + (some & (self.hits > 0)).sum()
        return n, m

    def bigrams(self, spread: tuple[np.ndarray, np.ndarray], buckets: int):
        """First and second words, counts and bucket of the different bigrams, sorted by bucket and words; each word's bigram."""
        code, at, n = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True, return_counts=True)
        m = np.bincount(at, self.hit, len(code)).astype(np.int64)
        h, w = self.words[code // len(self.words)], self.words[code % len(self.words)]
        bucket = T.mix(h)
        place, often = _find(spread[0], h)
        if often.any():
            bucket[often] += T.mix(~w[often]) % spread[1][place[often]]
        bucket = (bucket % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return h[order], w[order], n[order], m[order], bucket[order], rank[at]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is in the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
    T.release()


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A stable order by bucket, and the buckets' parts of it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])[: len(order)])
    return order, [(int(bucket[order[a]]), slice(a, b)) for a, b in zip(cuts, np.append(cuts[1:], len(order)))]


def _send_words(buckets: int):
    """Words of each batch, with their counts there, by bucket."""

    def run(batches):
        for row in _rows(batches):
            t = Texts(row)
            n, m = t.counts()
            order, parts = _by_bucket((T.mix(t.words) % _U(buckets)).astype(np.int64))
            lists = [order[part] for _, part in parts]
            yield _batch({"bucket": [b for b, _ in parts], "kind": [2] * len(parts), "g": [row["g"]] * len(parts), "words": [t.words[x].tobytes() for x in lists], "n": [squeezed(n[x]) for x in lists], "m": [squeezed(m[x]) for x in lists]}, LISTS)

    return run


def _grouped(batches):
    """Rows of one bucket at a time; the input is sorted by bucket."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _add_words(batches):
    """One list a bucket of all its words and their counts."""
    for held in _grouped(batches):
        w, n, m = (np.concatenate(x) for x in zip(*((np.frombuffer(r["words"], _U), unsqueezed(r["n"]), unsqueezed(r["m"])) for r in held)))
        words, at = np.unique(w, return_inverse=True)
        yield _batch({"bucket": [held[0]["bucket"]], "kind": [0], "words": [words.tobytes()], "n": [np.bincount(at, n).astype(np.int64).tobytes()], "m": [np.bincount(at, m).astype(np.int64).tobytes()]}, LISTS)


def _sums(batches):
    """Number of words, and their counts, START left out."""
    for row in _rows(batches):
        n, m = (np.frombuffer(row[c], np.int64) for c in ("n", "m"))
        own = np.frombuffer(row["words"], _U) != START
        yield _batch({"v": [int(own.sum())], "n": [int(n[own].sum())], "m": [int(m[own].sum())]}, "v long, n long, m long")


def _frequent(least: float):
    def run(batches):
        for row in _rows(batches):
            n = np.frombuffer(row["n"], np.int64)
            often = n > least
            yield _batch({"w": np.frombuffer(row["words"], np.int64)[often], "n": n[often]}, "w long, n long")

    return run


def _answer_words(batches):
    """To each list of words, their counts, and the counts and numbers of bigrams that they begin."""
    for held in _grouped(batches):
        known = np.zeros(0, _U)
        for r in held:
            if r["kind"] == 0:
                known = np.frombuffer(r["words"], _U)
                stats = np.zeros((6, len(known)), np.int64)
                stats[:2] = [np.frombuffer(r[c], np.int64) for c in ("n", "m")]
            elif r["kind"] == 1:
                at = np.searchsorted(known, np.frombuffer(r["words"], _U))
                stats[2:, at] += [unsqueezed(r[c]) for c in ("n", "m", "kinds", "kinds_m")]
            else:
                at = np.searchsorted(known, np.frombuffer(r["words"], _U))
                yield _batch({"kind": [1], "g": [r["g"]], "bucket": [r["bucket"]], "more": [b"".join(len(x).to_bytes(8, "little") + x for x in map(squeezed, stats[:, at]))]}, "kind int, g long, bucket int, more binary")


def _send(spread, buckets: int):
    """Bigrams of each batch by bucket: runs of first words, 48 bits of second words, counts."""

    def run(batches):
        for row in _rows(batches):
            h, w, n, m, bucket, _ = Texts(row).bigrams(spread.value, buckets)
            new = np.append(True, (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1]))[: len(h)]
            low = (w >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            out = {c: [] for c in ("bucket", "g", "h", "runs", "w", "n", "m")}
            for b, part in _by_bucket(bucket)[1]:
                at = part.start + np.flatnonzero(new[part])
                for c, x in (("bucket", b), ("g", row["g"]), ("h", h[at].tobytes()), ("runs", squeezed(np.diff(np.append(at, part.stop)))), ("w", low[part].tobytes()), ("n", squeezed(n[part])), ("m", squeezed(m[part]))):
                    out[c].append(x)
            if len(h):
                yield _batch(out, PAIR_LISTS)

    return run


def _add_pairs(buckets: int):
    """Answers (kind 2) to lists of bigrams, and for the words that begin them (kind 1) counts and numbers of bigrams, in lists
    to the words' buckets."""

    def run(batches):
        for held in _grouped(batches):
            h, w, n, m = (np.concatenate(x) for x in zip(*((np.repeat(np.frombuffer(r["h"], _U), unsqueezed(r["runs"])), np.pad(np.frombuffer(r["w"], np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel(), unsqueezed(r["n"]), unsqueezed(r["m"])) for r in held)))
            order = np.lexsort((w, h))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1]))
            at = np.flatnonzero(new)
            total = [np.add.reduceat(x[order], at) for x in (n, m)]
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            words, of = np.unique(h[order[at]], return_inverse=True)
            sums = [np.bincount(of, x).astype(np.int64) for x in (*total, total[0] > 0, total[1] > 0)]
            for b, part in (by := _by_bucket((T.mix(words) % _U(buckets)).astype(np.int64)))[1]:
                x = by[0][part]
                yield _batch({"kind": [1], "bucket": [b], "words": [words[x].tobytes()]} | {c: [squeezed(v[x])] for c, v in zip(("n", "m", "kinds", "kinds_m"), sums)}, LISTS + ", more binary")
            more = [t[which] - x for t, x in zip(total, (n, m))]
            cut = np.cumsum([0, *(len(r["w"]) // 6 for r in held)])
            for r, a, b in zip(held, cut, cut[1:]):
                some = more[0][a:b] > 0
                yield _batch({"kind": [2], "g": [r["g"]], "bucket": [r["bucket"]], "more": [np.packbits(some).tobytes()], "n": [squeezed(more[0][a:b][some])], "m": [squeezed(more[1][a:b][some])]}, LISTS + ", more binary")

    return run


ALL = PACKED + ", kind int, bucket int, more binary, n binary, m binary"


def _score(spread, buckets: int, size: int, totals: tuple[int, int], same: bool):
    """Scores of the texts of each batch, from its row (kind 0) and the answers to its words (1) and bigrams (2)."""

    def one(row: dict, answers: list[dict]):
        t = Texts(row)
        stats = np.zeros((6, len(t.words)), np.int64)
        *_, pn, pm, bucket, at = t.bigrams(spread.value, buckets)
        order, parts = _by_bucket((T.mix(t.words) % _U(buckets)).astype(np.int64))
        place = {b: order[part] for b, part in parts}
        for r in answers:
            if r["kind"] == 1:
                raw = r["more"]
                for k in range(6):
                    end = 8 + int.from_bytes(raw[:8], "little")
                    stats[k, place[r["bucket"]]], raw = unsqueezed(raw[8:end]), raw[end:]
            else:
                a, b = np.searchsorted(bucket, r["bucket"]), np.searchsorted(bucket, r["bucket"], "right")
                some = a + np.flatnonzero(np.unpackbits(np.frombuffer(r["more"], np.uint8), count=b - a))
                pn[some] += unsqueezed(r["n"])
                pm[some] += unsqueezed(r["m"])
        n, m, fn, fm = stats[0], stats[1], stats[2] - DISCOUNT * stats[4], stats[3] - DISCOUNT * stats[5]
        # what the text itself has counted is left out
        _, mine, times = np.unique(t.text * (len(pn) + 1) + at, return_inverse=True, return_counts=True)
        own = times[mine] if len(times) else at
        losses = []
        for c, left, mass, held, total in ((pm, own * t.hit, fm, m, totals[1]), (pn, own, fn, n, totals[0])) if not same else ((pn, own, fn, n, totals[0]),) * 2:
            held_ = np.maximum(held, 1)
            rest = np.maximum(1 - mass / held_, 1e-9)[t.before]
            uni = ((held + ADD) / (total + ADD * size))[t.tokens]
            loss = np.append(0.0, np.cumsum(-np.log(np.maximum(c[at] - left - DISCOUNT, 0) / held_[t.before] + rest * uni)))
            losses.append((loss[t.first[1:]] - loss[t.first[:-1]]) / np.maximum(np.diff(t.first), 1))
        cols = {"doc_id": row["ids"], "n_words": np.diff(t.first), "target_loss": losses[0], "background_loss": losses[1], "ce_diff": losses[0] - losses[1]}
        return _batch(cols, SCORES)

    def run(batches):
        row, answers = None, []
        for found in _rows(batches):
            if found["kind"]:
                answers.append(found)
                continue
            if row:
                yield one(row, answers)
            row, answers = found, []
        if row:
            yield one(row, answers)

    return run


def lm_scoring(docs: DataFrame, target_ids: DataFrame, batch: int = BATCH, pairs: int = PAIRS) -> DataFrame:
    """Per row: doc_id, n_words, target_loss, background_loss (means a word) and ce_diff. ``target_ids`` has doc_id."""
    spark = docs.sparkSession
    sc, parts = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct().withColumn("t", F.lit(True))
    marked = docs.join(small(ids, BROADCAST_IDS), docs.doc_id == F.col("t_id"), "left").select("doc_id", "text", F.coalesce("t", F.lit(False)).alias("hit"))
    packed = materialise(marked.mapInArrow(pack(batch), PACKED))
    buckets = max(parts, -(-(packed.agg(F.sum("size")).first()[0] or 0) // pairs))
    dealt = lambda df, *then: df.repartition(buckets, "bucket").sortWithinPartitions("bucket", *then)
    lists = packed.mapInArrow(_send_words(buckets), LISTS)
    words = materialise(dealt(lists).mapInArrow(_add_words, LISTS))
    size, *totals = (x or 0 for x in words.mapInArrow(_sums, "v long, n long, m long").agg(F.sum("v"), F.sum("n"), F.sum("m")).first())
    # first words that would fill a quarter of a bucket, there are few, go to several
    many = words.mapInArrow(_frequent(totals[0] / (4 * buckets)), "w long, n long").toArrow()
    key = many.column("w").to_numpy().view(_U)
    order = np.argsort(key)
    share = np.minimum(np.ceil(4 * buckets * many.column("n").to_numpy()[order] / max(1, totals[0])), buckets).astype(_U)
    spread = sc.broadcast((key[order], share))
    pairs_ = materialise(dealt(packed.mapInArrow(_send(spread, buckets), PAIR_LISTS)).mapInArrow(_add_pairs(buckets), LISTS + ", more binary"))
    asked = words.unionByName(pairs_.where("kind = 1").drop("more")).unionByName(lists.drop("n", "m"), True)
    answers = dealt(asked, "kind").mapInArrow(_answer_words, "kind int, g long, bucket int, more binary")
    every = packed.withColumn("kind", F.lit(0)).unionByName(answers, True).unionByName(pairs_.where("kind = 2").select("kind", "g", "bucket", "more", "n", "m"), True)
    every = every.select(*(c.split(" ")[0] for c in ALL.split(", ")))
    score = _score(spread, buckets, size + 2, (totals[0], totals[1]), not totals[1])
    return every.repartition(parts, "g").sortWithinPartitions("g", "kind").mapInArrow(score, SCORES)
