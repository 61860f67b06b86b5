"""Benchmark decontamination: BM25 inverted index of test items, searched by block-max WAND with every training passage.

Items are indexed by term with BM25 impacts, divided by ``share`` of the item's own score, so that one threshold of 1
serves all. Posting lists are cut into blocks of ``BLOCK`` items; the greatest impact of each block, and of each list,
bounds what a passage can score there. Passages of ``passage`` words, half overlapping, query the index. Bounds are first
added up for many passages at once; those whose lists, or whose best block, stay under the threshold are done. The others
go through block-max WAND: the pivot is the first item that the lists before it may lift over the threshold, blocks whose
bounds can't are skipped whole, and only items left are scored. All items at or above the threshold are retrieved. An item longer than a passage is indexed whole and also in parts of at most half a passage, each against
its own score; one part retrieves it. A retrieved item counts as leaked into a document if the document holds at least ``question`` of the
n-grams of its question (all but its last line, or its first four fifths) and ``answer`` of those of its answer.

The index is broadcast; benchmarks over ``shard_items`` items or ``shard_bytes`` bytes are searched shard by shard, so what
is broadcast stays bounded; document frequencies and lengths are always those of the whole benchmark. Words are case-sensitive runs of non-blanks. Null and blank texts and items never match.
Repeated rows and items are all reported. Extra columns pass through in ``keep_clean`` and are ignored in ``leaks``. Rows
with a null doc_id are reported with it. Empty documents or benchmarks give no leaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import materialise

PASSAGE, SHARE, QUESTION, ANSWER, GRAM, K1, B = 64, 0.5, 0.6, 0.5, 5, 1.2, 0.75
SHARD_ITEMS, SHARD_BYTES, BLOCK = 20_000, 32 << 20, 8
#: Bounds may be a rounding below the sum they bound.
NEARLY = 1 - 1e-6


def _parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    head, _, tail = text.strip("\x20\t\n\x0b\x0c\r").rpartition("\n")
    q, a = head.encode().split(), tail.encode().split()
    if not q:
        q, a = a[: max(1, len(a) * 4 // 5)], a[max(1, len(a) * 4 // 5) :]
    return q, a


def _hash_words(ws: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(ws), np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    return T.word_hash(data, starts, ends)


def _grams(h: np.ndarray) -> np.ndarray:
    return np.unique(T.gram_hash(h, min(GRAM, len(h)))) if len(h) else h


def _units(words: list[np.ndarray], passage: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What is retrieved: items, and of those longer than a passage also their parts; and the item of each."""
    out, of = list(words), list(range(len(words)))
    for i, w in enumerate(words):
        if len(w) > passage:
            # half a passage lies whole in one of the half overlapping passages
            parts = np.array_split(w, -(-len(w) // max(1, passage // 2)))
            out += parts
            of += [i] * len(parts)
    order = np.argsort(of, kind="stable")
    return [out[k] for k in order], np.array(of)[order]


def build_index(items: list[tuple[int, str]], share: float = SHARE, passage: int = PASSAGE, whole_: tuple[int, float, dict[int, int]] | None = None) -> dict | None:
    """``whole_``: number of items, mean length and document frequencies of the whole benchmark, if ``items`` is a part of it."""
    items = [(i, *map(_hash_words, _parts(t))) for i, t in items if t and t.split()]
    if not items:
        return None
    whole = [np.concatenate([q, a]) for _, q, a in items]
    vocab, df = np.unique(np.concatenate([np.unique(w) for w in whole]), return_counts=True)
    n_items, mean = len(items), np.mean([len(w) for w in whole])
    if whole_:
        n_items, mean, every = whole_
        df = np.array([every[int(t)] for t in vocab.view(np.int64)])
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    units, of = _units(whole, passage)
    terms = [np.unique(w, return_counts=True) for w in units]
    lengths = np.array([len(w) for w in units], np.float64)
    at = np.searchsorted(vocab, np.concatenate([t for t, _ in terms]))
    unit = np.repeat(np.arange(len(units)), [len(t) for t, _ in terms])
    tf = np.concatenate([c for _, c in terms]).astype(np.float64)
    impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[unit] / mean))
    own = np.bincount(unit, impact)
    impact = impact / (share * own[unit])
    order = np.argsort(at, kind="stable")
    at, unit, impact = at[order], unit[order], impact[order]
    n_blocks = -(-len(units) // BLOCK)
    cell = at * n_blocks + unit // BLOCK
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    block_max = np.maximum.reduceat(impact, starts)
    ends = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(vocab)))])
    list_max = np.zeros(len(vocab))
    np.maximum.at(list_max, at, impact)
    return {"ids": [i for i, *_ in items], "grams": [(_grams(q), _grams(a)) for _, q, a in items], "vocab": vocab, "of": of, "unit": unit, "impact": impact, "at": ends(at), "n_blocks": n_blocks, "block": cell[starts] % n_blocks, "block_max": block_max, "block_at": ends(at[starts]), "list_max": list_max}


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def wand(index: dict, query: np.ndarray) -> list[tuple[int, float]]:
    """(unit, score) of all units that score 1 or more for the terms of ``query``, by block-max WAND."""
    at, end, top = index["at"][query].copy(), index["at"][query + 1], index["list_max"][query]
    unit, impact, out = index["unit"], index["impact"], []
    bounds = [dict(zip(index["block"][a:b].tolist(), index["block_max"][a:b].tolist())) for a, b in zip(index["block_at"][query], index["block_at"][query + 1])]
    none = len(index["of"])
    current = np.where(at < end, unit[np.minimum(at, len(unit) - 1)], none)

    def move(which: np.ndarray, to: int) -> None:
        for i in which.tolist():
            at[i] += np.searchsorted(unit[at[i] : end[i]], to)
            current[i] = unit[at[i]] if at[i] < end[i] else none

    while True:
        order = np.argsort(current, kind="stable")
        over = np.flatnonzero((np.cumsum(top[order]) >= NEARLY) & (current[order] < none))
        if not len(over):
            return out
        pivot = int(current[order[over[0]]])
        before = np.flatnonzero(current <= pivot)
        block = pivot // BLOCK
        if sum(bounds[i].get(block, 0.0) for i in before.tolist()) < NEARLY:
            # no unit up to the end of the block, or to where a further list begins, can reach the threshold
            later = current[current > pivot]
            move(before, min((block + 1) * BLOCK, int(later.min()) if len(later) else none))
        elif (current[before] == pivot).all():
            score = float(impact[at[before]].sum())
            if score >= 1:
                out.append((pivot, score))
            move(before, pivot + 1)
        else:
            move(before[current[before] < pivot], pivot)


def retrieve(index: dict, ids: np.ndarray, doc: np.ndarray, place: np.ndarray, passage: int) -> dict[tuple[int, int], float]:
    """(document, item) -> best score of its passages. ids: terms of the words in the vocabulary; place: the word's number in its document."""
    half = passage // 2
    cell = doc * (1 << 32) + place // half
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    cells = cell[start]
    follows = np.append(cells[1:] == cells[:-1] + 1, False)
    # over whole lists
    most = np.add.reduceat(index["list_max"][ids], start)
    both = most + np.where(follows, np.append(most[1:], 0), 0)
    live = np.flatnonzero(both >= NEARLY)
    found: dict[tuple[int, int], float] = {}
    end, n_blocks = np.append(start[1:], len(ids)), index["n_blocks"]
    step = max(1, min(512, 4_000_000 // n_blocks))
    for part in range(0, len(live), step):
        some = live[part : part + step]
        stop = np.where(follows[some], end[np.minimum(some + 1, len(end) - 1)], end[some])
        owner = np.repeat(np.arange(len(some)), stop - start[some])
        term = np.unique(owner * len(index["vocab"]) + ids[_spread(start[some], stop)])
        owner, term = term // len(index["vocab"]), term % len(index["vocab"])
        # over blocks
        a, b = index["block_at"][term], index["block_at"][term + 1]
        entry = _spread(a, b)
        bound = np.bincount(np.repeat(owner, b - a) * n_blocks + index["block"][entry], index["block_max"][entry], len(some) * n_blocks).reshape(len(some), n_blocks)
        for i in np.flatnonzero((bound >= NEARLY).any(1)):
            for u, score in wand(index, term[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]):
                key = (int(doc[start[some[i]]]), int(index["of"][u]))
                found[key] = max(found.get(key, 0.0), score)
    return found


def _search(index: dict, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, passage: int, question: float, answer: float):
    """(row, item number, score, question overlap, answer overlap) of the verified leaks."""
    starts, ends, first = T.words(data, off)
    if not len(starts):
        return []
    h = T.word_hash(data, starts, ends)
    ids = np.searchsorted(index["vocab"], h)
    ids[ids == len(index["vocab"])] = 0
    known = np.flatnonzero(index["vocab"][ids] == h)
    if not len(known):
        return []
    doc = np.searchsorted(first, known, "right") - 1
    found = retrieve(index, ids[known], doc, known - first[doc], passage)
    out = []
    held: dict[tuple[int, int], np.ndarray] = {}
    for (d, item), score in sorted(found.items()):
        mine = h[first[d] : first[d + 1]]

        def overlap(grams: np.ndarray, words: int) -> float:
            n = min(GRAM, words)
            if (d, n) not in held:
                held[d, n] = np.unique(T.gram_hash(mine, n))
            return float(np.isin(grams, held[d, n]).mean()) if len(grams) else 1.0

        q, a = index["grams"][item]
        qo, ao = overlap(q, index["sizes"][item][0]), overlap(a, index["sizes"][item][1])
        if qo >= question and ao >= answer:
            out.append((d, item, score, qo, ao))
    return out


def _terms(batches):
    """Per item its different words, hashed, with its shard; the first row of an item also has its number of words."""
    for rows, data, off in T.chunks(batches):
        starts, ends, first = T.words(data, off)
        h, shard = T.word_hash(data, starts, ends), T.column(rows, "shard").to_numpy()
        for i in np.flatnonzero(np.diff(first)):
            t = np.unique(h[first[i] : first[i + 1]])
            size = np.zeros(len(t), np.int64)
            size[0] = first[i + 1] - first[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), shard[i])), T.long(t), pa.array(size)], ["shard", "t", "size"])


def _indexes(benchmark: DataFrame, share: float, passage: int):
    """Broadcast indexes of the benchmark, or of its parts of bounded size."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    k = max(1, -(-n // SHARD_ITEMS), -(-size // SHARD_BYTES))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(k)))
    whole = None
    if k > 1:
        terms = materialise(items.mapInArrow(_terms, "shard long, t long, size long"))
        seen = materialise(terms.groupBy("t").agg(F.count("*").alias("df")))
        n_items, total = terms.agg(F.sum((F.col("size") > 0).cast("long")), F.sum("size")).first()
    for i in range(k):
        if k > 1:
            own = terms.where(F.col("shard") == i).select("t").distinct().join(seen, "t").toArrow()
            whole = (n_items, total / max(1, n_items or 1), dict(zip(own.column("t").to_pylist(), own.column("df").to_pylist()))) if n_items else None
        rows = sorted(((r["item_id"], r["text"]) for r in items.where(F.col("shard") == i).collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        index = build_index(rows, share, passage, whole)
        if index:
            index["sizes"] = [tuple(map(len, _parts(t))) for _, t in rows if t and t.split()]
            yield sc.broadcast(index)


def leaks(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, share: float = SHARE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """Per leaked item of a document: doc_id, item_id, score (of the best passage, 1 is the threshold), question_overlap, answer_overlap."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _indexes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), share, passage):

        def run(batches, index=index):
            for rows, data, off in T.chunks(batches):
                hits = _search(index.value, rows, data, off, passage, question, answer)
                if hits:
                    ids = T.column(rows, "doc_id").to_pylist()
                    cols = list(zip(*((ids[d], index.value["ids"][i], round(s, 6), q, a) for d, i, s, q, a in hits)))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, share: float = SHARE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with its columns; nothing is shuffled."""
    for index in _indexes(benchmark, share, passage):

        def run(batches, index=index):
            for rows, data, off in T.chunks(batches):
                keep = np.ones(rows.num_rows, bool)
                keep[[d for d, *_ in _search(index.value, rows, data, off, passage, question, answer)]] = False
                yield rows if keep.all() else rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
