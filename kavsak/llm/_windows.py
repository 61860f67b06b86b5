"""Repeated windows of a corpus, found through minimisers (super-k-mers).

A window is ``width`` consecutive tokens (bytes or words) of one document. Consecutive windows whose least k-gram is the
same occurrence form a run, and a run's tokens form one string. Equal windows have equal minimisers, so only runs whose
minimiser occurs elsewhere matter; of these, runs that are all equal need no comparison, and one of each different string
travels, packed, to the bucket of its minimiser, where its windows are compared exactly.

Counts of minimisers and strings are combined before the shuffle. A minimiser with more than ``hot`` different strings is
dealt out by the fingerprints of its windows instead of going to one bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import forget, materialise, small

#: Different strings of one minimiser that are compared in one task.
HOT = 60_000
#: Hot minimisers up to which they are broadcast; more are joined by a shuffle.
BROADCAST_HOT = 1_000_000


def runs_of(tokens: np.ndarray, first: np.ndarray, width: int, k: int, lag: int = 0):
    """Runs of windows: minimiser, fingerprint of the string, document, first window, number of windows. Each token stands
    for itself and the ``lag`` ones after it."""
    h = T.gram_hash(tokens, k - lag)
    w = width - k + 1
    least = T.window_min(h, w)
    if not len(least):
        none = np.zeros(0, np.int64)
        return h[:0], h[:0], none, none, none
    count = np.diff(first) - width + 1
    some = count > 0
    edge = np.zeros(len(tokens) + 2, np.int32)
    edge[first[:-1][some]] += 1
    edge[(first[:-1] + count)[some]] -= 1
    valid = np.cumsum(edge)[: len(least)] > 0
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    a = np.flatnonzero(start)
    last = np.flatnonzero(valid & ~np.append(valid[1:] & ~start[1:], False))
    n = last - a + 1
    s = T.span_hash(T.prefix_hash(tokens, 1), a, a + n - 1 + width - lag, 1)
    return least[a], s, np.searchsorted(first, a, "right") - 1, a, n


def emit(width: int, k: int, by_words: bool):
    def run(batches):
        for rows, data, off in T.chunks(batches):
            if by_words:
                starts, ends, first = T.words(data, off)
                tokens = T.word_hash(data, starts, ends)
            else:
                first, tokens = off, T.octets(data)
            h, s, doc, a, n = runs_of(tokens, first, width, k, 0 if by_words else 7)
            if not len(a):
                continue
            doc_id, th = (T.column(rows, x).take(pa.array(doc)) for x in ("doc_id", "th"))
            out = [T.long(h), T.long(s), doc_id, th, pa.array((a - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
            if by_words:
                b0, b1 = starts[a] - off[doc], ends[a + n - 2 + width] - off[doc]
            else:
                b0, b1 = a - off[doc], a + n - 1 + width - off[doc]
            out += [pa.array(b0.astype(np.int32)), pa.array((b1 - b0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["h", "s", "doc_id", "th", "a", "n", "b0", "nb"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows with one doc_id apart, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def candidates(docs: DataFrame, width: int, k: int, by_words: bool) -> DataFrame:
    """Runs whose minimiser may hold a repeated window; ``one`` if all runs of the minimiser are the same string."""
    runs = docs.mapInArrow(emit(width, k, by_words), "h long, s long, doc_id long, th long, a int, n int, b0 int, nb int")
    found = runs.groupBy("h").agg(F.count("*").alias("c"), F.min("s").alias("s0"), F.max("s").alias("s1"), *([F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")] if by_words else []))
    # written, so that the join's own shuffles can be split where a minimiser is frequent
    found = materialise(found.where("d1 > d0" if by_words else "c > 1").select("h", (F.col("s0") == F.col("s1")).alias("one"), *(["d0"] if by_words else [])))
    return materialise(runs.join(found, "h"), found)


def pieces(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    return T.binary(rows.column(name).combine_chunks() if rows.num_rows else rows.column(name))


def grouped(batches, limit: int):
    """Tables of whole groups of h, of about ``limit`` windows each, without repeated (h, s); the input is sorted by h, s."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += int(np.sum(T.column(batch, "n").to_numpy()))
        if size > limit:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield unique(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = int(np.sum(table.column("n").to_numpy()[cut:]))
    if held:
        yield unique(pa.Table.from_batches(held))
    held.clear()
    T.release()


def unique(table: pa.Table) -> pa.Table:
    h, s = table.column("h").to_numpy(), table.column("s").to_numpy()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    return table if new.all() else table.filter(pa.array(new))


def spans(table: pa.Table, first: np.ndarray, value: np.ndarray, take: np.ndarray, with_value: bool) -> pa.RecordBatch:
    """For each string the flat list lo, hi[, value] of its maximal ranges of taken windows with one value."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, end = take.copy(), take.copy()
    same = (owner[1:] == owner[:-1]) & take[1:] & take[:-1] & (value[1:] == value[:-1])
    start[1:] &= ~same
    end[:-1] &= ~same
    lo, hi = np.flatnonzero(start), np.flatnonzero(end) + 1
    who = owner[lo]
    flat = np.stack([lo - first[who], hi - first[who]] + [value[lo]] * with_value, 1).astype(np.int64)
    rows, counts = np.unique(who, return_counts=True)
    off = np.concatenate([[0], np.cumsum(counts * flat.shape[1])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat.ravel()))
    picked = table.select(["h", "s"]).take(pa.array(rows)).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.array(picked.column(0).to_numpy()), pa.array(picked.column(1).to_numpy()), lists], ["h", "s", "spans"])


def repeated(docs: DataFrame, width: int, k: int, by_words: bool, compare, fingerprints, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, th, a, spans) of runs with repeated windows; spans as ``spans`` gives them.

    ``compare`` works on the strings of whole minimisers; ``fingerprints`` gives windows (f1, f2, h, s, i) of hot ones.
    """
    docs = keyed(docs)
    cand = candidates(docs.where("doc_id is not null") if by_words else docs, width, k, by_words)
    if by_words:
        whole = cand.where("one and doc_id > d0").select("doc_id", "th", "a", F.array(F.lit(0).cast("long"), F.col("n").cast("long"), F.col("d0")).alias("spans"))
    else:
        whole = cand.where("one").select("doc_id", "th", "a", F.array(F.lit(0).cast("long"), F.col("n").cast("long")).alias("spans"))
    many = cand.where("not one")
    strings = many.groupBy("h", "s").agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *(F.first(x).alias(x) for x in ("n", "b0", "nb")), F.first("doc_id").alias("doc_id"), F.first("th").alias("th"))
    strings = materialise(strings)
    # at most one for ``hot`` strings, usually none: strings aren't shuffled by their minimiser to find theirs
    crowd = materialise(strings.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("hot")))
    crowded = not crowd.isEmpty()
    packed = strings.join(small(crowd, BROADCAST_HOT), "h", "left") if crowded else strings.withColumn("hot", F.lit(None).cast("boolean"))
    if not crowded:
        forget(crowd)
    packed = packed.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    packed = packed.join(docs, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    packed = packed.select("h", "s", "c", "lo", "hi", "n", "hot", F.expr("substring(cast(text as binary), b0 + 1, nb)").alias("packed"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    usual = packed.where("hot is null").drop("hot").repartition(int(parts), "h").sortWithinPartitions("h", "s").mapInArrow(compare, "h long, s long, spans array<long>")
    if crowded:
        # repeated rows of one document pack the same string twice
        own = packed.where("hot").dropDuplicates(["h", "s"]).drop("hot").mapInArrow(fingerprints, "f1 long, f2 long, h long, s long, c long, lo long, hi long, i long")
        own = materialise(own)
        seen = own.groupBy("f1", "f2").agg(F.sum("c").alias("cc"), F.min("lo").alias("low"))
        own = own.join(seen.where("cc > 1"), ["f1", "f2"])
        if by_words:
            own = own.where("low < hi").groupBy("h", "s").agg(F.flatten(F.collect_list(F.array("i", F.col("i") + 1, "low"))).alias("spans"))
        else:
            own = own.groupBy("h", "s").agg(F.flatten(F.collect_list(F.array("i", F.col("i") + 1))).alias("spans"))
        usual = usual.union(own)
    return whole.union(many.join(usual, ["h", "s"]).select("doc_id", "th", "a", "spans"))


def finish(docs: DataFrame, found: DataFrame, function, schema: str) -> DataFrame:
    """Each document with its runs (none: an empty list) goes through ``function``. Equal rows bring equal runs, which
    count once."""
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("a", "spans")).alias("runs"))
    docs = keyed(docs)
    joined = docs.join(found, docs.doc_id.eqNullSafe(found.d) & (docs.th == found.t), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(function, schema)
