"""Removal of word windows that an earlier document holds, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket (see ``_windows``). A
bucket sorts its windows, by 128-bit fingerprints first and, where these are equal, word by word, and takes the least
doc_id of each; a document loses the words that a window covers whose least doc_id is smaller than its own.

Words are runs of bytes other than blanks, unchanged. Null and empty texts have no words. Rows with one doc_id don't
remove each other's words; rows with a null doc_id neither remove nor lose words. Texts shorter than a window are kept.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from . import _windows as W

#: Words of a window and of the k-grams that lead to a bucket; windows sorted at once.
WIDTH, K, AT_ONCE = 50, 8, 1_000_000


def _layout(table: pa.Table, width: int):
    """For each window of the packed strings its string, number there, first word and two fingerprints; and the words, numbered."""
    data, off = W.pieces(table, "packed")
    starts, ends, first_word = T.words(data, off)
    n = np.diff(first_word) - width + 1
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(first[-1]) - first[owner]
    at = first_word[owner] + inner
    h = [T.word_hash(data, starts, ends, x) for x in (0, 1)]
    f = [T.span_hash(T.prefix_hash(h[x], x), at, at + width, x) for x in (0, 1)]
    return first, owner, inner, at, f, T.numbered(data, starts, ends, h[0])


def sorted_windows(at: np.ndarray, f: list[np.ndarray], words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and where a window differs from the one before it; word by word."""
    order = np.lexsort((f[1], f[0]))
    alike = (f[0][order][1:] == f[0][order][:-1]) & (f[1][order][1:] == f[1][order][:-1])
    pairs = np.flatnonzero(alike)
    a, b = at[order[pairs]], at[order[pairs + 1]]
    same = np.ones(len(pairs), bool)
    for j in range(width):
        same &= words[a + j] == words[b + j]
    if not same.all():
        # equal fingerprints of different windows: sort these by their words
        group = np.cumsum(np.append(True, ~alike))
        for g in np.unique(group[pairs[~same]]):
            where = np.flatnonzero(group == g)
            order[where] = sorted(order[where].tolist(), key=lambda i: tuple(words[at[i] : at[i] + width].tolist()))
        a, b = at[order[pairs]], at[order[pairs + 1]]
        same = np.array([(words[x : x + width] == words[y : y + width]).all() for x, y in zip(a, b)], bool)
    new = np.ones(len(order), bool)
    new[pairs[same] + 1] = False
    return order, new


def compare(width: int):
    def run(batches):
        for table in W.grouped(batches, AT_ONCE):
            first, owner, _, where, f, words = _layout(table, width)
            order, new = sorted_windows(where, f, words, width)
            at = np.flatnonzero(new)
            low = table.column("lo").to_numpy()[owner]
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.append(at, len(order))))
            take = least < table.column("hi").to_numpy()[owner]
            if take.any():
                yield W.spans(table, first, least, take, True)

    return run


def fingerprints(width: int):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                table = pa.Table.from_batches([batch.slice(part, 1000)])
                _, owner, inner, _, f, _ = _layout(table, width)
                keep = [table.column(x).to_numpy()[owner] for x in ("h", "s", "c", "lo", "hi")]
                yield pa.RecordBatch.from_arrays([T.long(f[0]), T.long(f[1]), *map(T.long, keep), T.long(inner)], ["f1", "f2", "h", "s", "c", "lo", "hi", "i"])

    return run


def _remove(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for rows, data, off in T.chunks([batch]):
                starts, ends, first = T.words(data, off)
                docs, runs = T.column(rows, "doc_id").to_pylist(), T.column(rows, "runs").to_pylist()
                edge = np.zeros(len(starts) + 1, np.int32)
                for i, found in enumerate(runs):
                    for r in found or ():
                        at = first[i] + r["a"]
                        for x in range(0, len(r["spans"]), 3):
                            if r["spans"][x + 2] < docs[i]:
                                edge[at + r["spans"][x]] += 1
                                edge[at + r["spans"][x + 1] - 1 + width] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                raw = data.tobytes()
                for i, doc in enumerate(docs):
                    lo, hi = first[i], first[i + 1]
                    kept = raw[off[i] : off[i + 1]].split() if not gone[lo:hi].any() else [raw[starts[j] : ends[j]] for j in range(lo, hi) if not gone[j]]
                    kept = b" ".join(kept)
                    out.append((doc, hi - lo, int(gone[lo:hi].sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, k: int = K, hot: int = W.HOT) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and ``kept``, the remaining words joined by blanks."""
    found = W.repeated(docs, width, k, True, compare(width), fingerprints(width), hot)
    return W.finish(docs, found, _remove(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
