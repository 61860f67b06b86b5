"""Byte-exact removal of long repeats by suffix sorting (deep-shallow).

Suffixes matter only up to ``width`` bytes and only where their minimiser repeats (see ``_windows``). In each bucket the
remaining suffixes are ordered as deep-shallow sorting does: multikey quicksort, on characters of eight bytes, down to a
shallow depth; then each group with a long common prefix goes into a blind trie, which keeps only branching depths and
branching characters. The trie is built path by path for all groups at once: members are compared with their group's
first suffix, equal ones end there, the others hang off its path at (depth, character) and form the next groups.

Null and empty texts have no bytes and lose none. Repeated rows are copies of each other. Texts shorter than ``width``
are kept. Extra columns are ignored. An empty table gives an empty result. Rows with a null doc_id count like others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from . import _windows as W

#: Length of the strings and of the k-grams that lead to a bucket; depth of the multikey phase; windows sorted at once.
WIDTH, K, SHALLOW, AT_ONCE = 200, 32, 16, 250_000
_U = np.uint64


def _split(idx: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by keys, the first being the most significant; return the members of groups of two and more, and group numbers."""
    order = np.lexsort(keys[::-1])
    idx = idx[order]
    new = np.ones(len(idx), bool)
    new[1:] = False
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    alone = new & np.append(new[1:], True)
    return idx[~alone], np.cumsum(new & ~alone)[~alone]


def equal_suffixes(data: np.ndarray, pos: np.ndarray, group: np.ndarray, width: int, shallow: int = SHALLOW) -> np.ndarray:
    """Which of the suffixes at ``pos`` share their first ``width`` bytes with another of their group."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    char = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    flagged = np.zeros(len(pos), bool)
    idx, g = _split(np.arange(len(pos)), group)
    for d in range(0, min(shallow, width - 7), 8):
        idx, g = _split(idx, g, char[pos[idx] + d])
    depth = np.full(len(idx), min(shallow, width // 8 * 8))
    while len(idx):
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        lead = idx[np.repeat(first, np.diff(np.append(first, len(g))))]
        live = np.flatnonzero(idx != lead)
        at, branch = depth.copy(), np.full(len(idx), -1)
        while len(live):
            cut = (8 * np.maximum(8 - (width - at[live]), 0)).astype(_U)
            x = (char[pos[idx[live]] + at[live]] ^ char[pos[lead[live]] + at[live]]).astype(_U) >> cut << cut
            off = x != 0
            out, x = live[off], x[off]
            at[out] += sum((x < _U(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
            branch[out] = data[pos[idx[out]] + at[out]]
            live = live[~off]
            at[live] = np.minimum(at[live] + 8, width)
            live = live[at[live] < width]
        equal = (branch < 0) & (idx != lead)
        flagged[idx[equal]] = True
        flagged[lead[equal]] = True
        rest = np.flatnonzero(branch >= 0)
        depth_of = np.zeros(len(pos), np.int64)
        depth_of[idx[rest]] = at[rest]
        idx, g = _split(idx[rest], g[rest], at[rest], branch[rest])
        depth = depth_of[idx]
    return flagged


def _layout(table: pa.Table, width: int, k: int):
    """Bytes of the packed strings, their windows' numbers, and the places of their minimisers."""
    data, off = W.pieces(table, "packed")
    n = table.column("n").to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    h = table.column("h").to_numpy()
    grams = T.gram_hash(T.octets(data), k - 7).view(np.int64)
    of = np.repeat(h, np.diff(off))[: len(grams)]
    hits = np.flatnonzero(grams == of)
    anchor = hits[np.searchsorted(hits, off[:-1])] - off[:-1]
    return data, off, n, first, h, anchor


def compare(width: int, k: int):
    def run(batches):
        for table in W.grouped(batches, AT_ONCE):
            data, off, n, first, h, anchor = _layout(table, width, k)
            number = np.cumsum(np.append(False, h[1:] != h[:-1])).astype(np.int64) * (2 * width)
            take = np.repeat(table.column("c").to_numpy() > 1, n)
            # equal windows lie equally far from their minimiser: some distances at a time bound the memory
            step = max(1, AT_ONCE // len(n))
            for low in range(0, width - k + 1, step):
                far = np.arange(low, min(low + step, width - k + 1))
                inner = anchor[:, None] - far[None, :]
                who, what = np.nonzero((inner >= 0) & (inner < n[:, None]))
                inner = inner[who, what]
                take[first[who] + inner] |= equal_suffixes(data, off[who] + inner, number[who] + far[what], width)
            if take.any():
                yield W.spans(table, first, np.zeros(len(take), np.int64), take, False)

    return run


def fingerprints(width: int, k: int):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                table = pa.Table.from_batches([batch.slice(part, 1000)])
                data, off, n, first, *_ = _layout(table, width, k)
                owner = np.repeat(np.arange(len(n)), n)
                inner = np.arange(first[-1]) - first[owner]
                at = off[owner] + inner
                f = [T.span_hash(T.prefix_hash(T.octets(data), x), at, at + width - 7, x) for x in (0, 1)]
                keep = table.select(["h", "s", "c", "lo", "hi"]).take(pa.array(owner)).combine_chunks()
                yield pa.RecordBatch.from_arrays([T.long(f[0]), T.long(f[1]), *(pa.array(keep.column(x).to_numpy()) if x != "lo" and x != "hi" else keep.column(x).combine_chunks() for x in ("h", "s", "c", "lo", "hi")), T.long(inner)], ["f1", "f2", "h", "s", "c", "lo", "hi", "i"])

    return run


def _remove(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, runs in zip(T.column(batch, "doc_id").to_pylist(), T.column(batch, "text"), T.column(batch, "runs").to_pylist()):
                raw = text.as_py().encode()
                if not runs:
                    out.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                for r in runs:
                    for i in range(0, len(r["spans"]), 2):
                        edge[r["a"] + r["spans"][i]] += 1
                        edge[r["a"] + r["spans"][i + 1] - 1 + width] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, width: int = WIDTH, k: int = K, hot: int = W.HOT) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the remaining bytes."""
    found = W.repeated(docs, width, k, False, compare(width, k), fingerprints(width, k), hot)
    return W.finish(docs, found, _remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
