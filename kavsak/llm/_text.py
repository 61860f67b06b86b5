"""Vectorised text handling on Arrow batches: words, hashes of spans, sliding minima.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a character.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 1 << 19
#: Bytes of a span from which on it is hashed by itself.
LONG = 1 << 12
#: Fixed odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Give freed memory back: a worker that waits for its next task still counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches, limit: int = CHUNK_BYTES, column: str = "text"):
    """Yield (rows, bytes, offsets) with about ``limit`` bytes of text each; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
        start = 0
        while start < len(col):
            stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), data[off[start] : off[stop]], off[start : stop + 1] - off[start]
            start = stop
    release()


def words(data: np.ndarray, off: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (one entry more at the end)."""
    word = ~blank[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables or len(_tables[which][0]) < n:
        m = max(n, 1 << 19)
        both = []
        for x in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            t = np.full(m, x, _U)
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _tables[which] = tuple(both)
    return _tables[which]


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``values``."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * _powers(len(values) + 1, which)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end], wherever the span lies."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix), which)[1][start])


def gram_hash(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k values."""
    p, n = prefix_hash(values, which), len(values) - k + 1
    return mix((p[k:] - p[:-k]) * _powers(len(p), which)[1][:n]) if n > 0 else np.zeros(0, _U)


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one mixed number, zeros after the end. Spans of bytes are hashed by these: sums of
    powers of single bytes collide on texts such as Thue-Morse words."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return mix(np.ndarray((len(data),), ">u8", held, strides=(1,)).astype(_U))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes a round; spans over LONG bytes are hashed by BLAKE2."""
    n = (ends - starts).astype(np.int64)
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), ">u8", held, strides=(1,))
    h = mix(n.astype(_U) + _U(BASES[which]))
    live, r = np.flatnonzero(n <= LONG), 0
    while len(live := live[n[live] > r]):
        cut = (8 * np.maximum(8 - (n[live] - r), 0)).astype(_U)
        h[live] = mix(h[live] * _U(BASES[which]) ^ eight[starts[live] + r].astype(_U) >> cut << cut)
        r += 8
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([which])).digest(), "little")
    return h


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each span that equal bytes, and only those, share; ``h`` are hashes of the spans."""
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    n, like = ends - starts, first[same]
    if (n == n[like]).all():
        moved = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(starts, n) + moved] == data[np.repeat(starts[like], n) + moved]).all():
            return same
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: block-wise prefix and suffix minima."""
    m = len(h) - w + 1
    if m <= 0:
        return h[:0]
    x = np.concatenate([h, np.full(-len(h) % w, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(x, 1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suf[:m], pre[w - 1 : w - 1 + m])


def long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed longs."""
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]
