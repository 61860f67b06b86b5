"""Near-duplicate join on five-word shingles: MinHash LSH forest, then exact verification.

Each different text gets ``trees`` labels of ``longest`` min-hashes. A tree is the prefix trie of its labels: the texts that
share a label's first p min-hashes are one node of depth p. The forest is walked from the deepest nodes upwards. At each
depth, nodes are made in all trees by sorting labels' prefixes together, and their members are paired with the node's least
member; the agreement of all min-hashes tells how similar a pair is about (s), and how likely a pair of that similarity
shares a node of this depth in some tree: c = 1 - (1 - s^p)^trees. Found pairs stand for 1/c pairs each, and three more at
the least wanted similarity for those of which none may have been seen. Prefixes are shortened until the share found
reaches ``recall``; at that depth, texts that share a node are the candidates.

Candidates of a node are chained to its least member, so nodes of any size give one edge a member; chains are merged to
groups, and each different text travels once to its group, where the shingle sets of all candidate pairs, those that share
a node, are compared exactly. Groups with more than ``most`` texts or ``most_grams`` shingles are cut into blocks, and pairs
of blocks are worked on as tasks of bounded size.

Equal texts are one class and are linked with one another. Texts of one to four words have no shingle: they are linked
with equal texts only. Null and blank texts are linked with nothing, each its own class. A class is a connected group of
links and is named by its least doc_id; n_links counts the other rows that a row is linked with, repeated rows included.
Rows with a null doc_id take part (a class of only such rows has a null name). Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import components, forget, materialise

SHINGLE, SIMILARITY, RECALL, TREES, LONGEST = 5, 0.8, 0.999, 16, 10
#: Different texts, and shingles, of a group that one task compares.
MOST, MOST_GRAMS = 1500, 3_000_000
#: Pairs at the least similarity that may exist though none was found (95 % sure, the rule of three).
UNSEEN = 3.0
_U = np.uint64


def caught(similarity: float, depth: int, trees: int) -> float:
    """The chance that two texts of this similarity share a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def estimated_recall(agree: dict[int, int], depth: int, trees: int, longest: int, similarity: float) -> float:
    """Share of the wanted pairs that are found at this depth; ``agree``: numbers of pairs by how many min-hashes agree."""
    n, missed = 0, UNSEEN * (1 / caught(similarity, depth, trees) - 1)
    total = trees * longest
    for equal, pairs in agree.items():
        # two deviations below the least wanted similarity may still be wanted
        if equal / total >= similarity - 2 * (similarity * (1 - similarity) / total) ** 0.5:
            n += pairs
            missed += pairs * (1 / caught(max(equal / total, similarity), depth, trees) - 1)
    return n / (n + missed) if n else 1 - missed / UNSEEN


def _sign(trees: int, longest: int, shingle: int):
    """Per text: numbers of words and shingles, and ``label``: for each tree its min-hashes, two bytes each."""
    rng = np.random.default_rng(20240229)
    flip, factor = (rng.integers(0, 1 << 63, trees * longest, dtype=np.int64).astype(_U) for _ in range(2))
    factor = factor * _U(2) + _U(1)

    def run(batches):
        for rows, data, off in T.chunks(batches, 1 << 20):
            starts, ends, first = T.words(data, off)
            grams = T.gram_hash(T.word_hash(data, starts, ends), shingle)
            n_words = np.diff(first)
            n = np.maximum(n_words - shingle + 1, 0)
            some = np.flatnonzero(n)
            label = np.zeros((rows.num_rows, trees * longest), ">u2")
            if len(some):
                owner = np.repeat(np.arange(len(n)), n_words)
                x = grams[owner[: len(grams)] == owner[shingle - 1 :]]
                at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                for j in range(trees * longest):
                    label[some, j] = (T.mix(np.minimum.reduceat((x ^ flip[j]) * factor[j], at)) >> _U(48)).astype(np.uint16)
            held = pa.Array.from_buffers(pa.binary(2 * trees * longest), len(label), [None, pa.py_buffer(label.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([T.column(rows, "doc_id"), T.column(rows, "nid"), pa.array(n_words.astype(np.int32)), pa.array(n.astype(np.int32)), held], ["doc_id", "nid", "n_words", "n_grams", "label"])

    return run


def _agreement(batches):
    """How many min-hashes of two labels agree."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(T.binary(T.column(batch, c))[0], ">u2").reshape(batch.num_rows, -1) for c in ("label", "other"))
            yield pa.RecordBatch.from_arrays([pa.array((a == b).sum(1).astype(np.int32))], ["agree"])


def _prefixes(nodes: DataFrame, depth: int, trees: int, longest: int) -> DataFrame:
    """(nid, tree, prefix) of each text with shingles."""
    leaves = nodes.where("n_grams > 0").select("nid", "label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return leaves.select("nid", "tree", F.substring("label", 2 * longest * F.col("tree") + 1, F.lit(2 * depth)).alias("prefix"))


def walk(nodes: DataFrame, similarity: float, recall: float, trees: int, longest: int) -> tuple[DataFrame, int]:
    """Pairs (u, v) of a node's members with its least one, at the greatest depth that reaches the recall; and that depth."""
    label = nodes.select(F.col("nid").alias("n"), "label")
    for depth in range(longest, 0, -1):
        # a depth that can't reach the recall even for the pairs it is sure to have found need not be tried
        if caught(similarity ** (1 / 3), depth, trees) < recall and depth > 1:
            continue
        leaves = _prefixes(nodes, depth, trees, longest)
        heads = leaves.groupBy("tree", "prefix").agg(F.min("nid").alias("head"), F.count("*").alias("c")).where("c > 1")
        pairs = materialise(leaves.join(heads, ["tree", "prefix"]).where("nid <> head").select(F.col("nid").alias("u"), F.col("head").alias("v")).distinct())
        both = pairs.join(label, pairs.u == label.n).select("v", "label")
        other = label.select(F.col("n").alias("o"), F.col("label").alias("other"))
        seen = both.join(other, both.v == other.o).select("label", "other").mapInArrow(_agreement, "agree int").groupBy("agree").count().collect()
        if depth == 1 or estimated_recall({r["agree"]: r["count"] for r in seen}, depth, trees, longest, similarity) >= recall:
            return pairs, depth
        forget(pairs)
    raise AssertionError("a depth of 1 is always taken")


def _sets(table: pa.Table, shingle: int):
    """Distinct (text, shingle) pairs of a group's texts, shingles numbered, and set sizes."""
    data, off = T.binary(table.column("text").combine_chunks())
    starts, ends, first = T.words(data, off)
    grams = T.gram_hash(T.word_hash(data, starts, ends), shingle)
    owner = np.repeat(np.arange(table.num_rows), np.diff(first))
    whole = owner[: len(grams)] == owner[shingle - 1 :] if len(grams) else np.zeros(0, bool)
    owner, grams = owner[: len(grams)][whole], grams[whole]
    _, ids = np.unique(grams, return_inverse=True)
    pair = np.unique(owner.astype(np.int64) * (ids.max() + 1 if len(ids) else 1) + ids)
    owner, ids = (pair // (ids.max() + 1), pair % (ids.max() + 1)) if len(ids) else (pair, pair)
    return owner, ids, np.bincount(owner, minlength=table.num_rows)


def intersections(owner: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Sizes of all pairwise intersections: rare shingles pair by pair, frequent ones by matrix products."""
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    df = np.bincount(ids)
    out = np.zeros((m, m), np.float32)
    at = np.concatenate([[0], np.cumsum(df)])
    rare = (df > 1) & (df <= min(16, max(2, m // 12)))
    for d in np.unique(df[rare]):
        who = owner[at[:-1][rare & (df == d)][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(out, (who[:, i], who[:, j]), 1)
    out += out.T
    often = np.flatnonzero((df > 1) & ~rare)
    for part in range(0, len(often), 2048):
        cols = often[part : part + 2048]
        one = np.zeros((m, len(cols)), np.float32)
        place = np.repeat(np.arange(len(cols)), df[cols])
        one[owner[np.concatenate([np.arange(at[c], at[c + 1]) for c in cols])], place] = 1
        out += one @ one.T
    return out


def candidate_pairs(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs i < j with a key in common in some column, or None if there may be more than ``most``."""
    m, trees = keys.shape
    found, room = [], 4 * most
    for t in range(trees):
        order = np.argsort(keys[:, t], kind="stable")
        k = keys[order, t]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, m))
        room -= int((size * (size - 1) // 2).sum())
        if room < 0:
            return None
        for c in np.unique(size[size > 1]):
            members = order[start[size == c][:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            a, b = members[:, i].ravel(), members[:, j].ravel()
            found.append(np.minimum(a, b) * m + np.maximum(a, b))
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return (code // m, code % m) if len(code) <= most else None


def pair_intersections(owner: np.ndarray, ids: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some pairs; owner and ids are sorted together."""
    n = int(ids.max()) + 1 if len(ids) else 1
    have, at = owner * n + ids, np.concatenate([[0], np.cumsum(size)])
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    out, step = np.zeros(len(a), np.int64), max(1, 2_000_000 // max(1, int(size.max(initial=1))))
    for part in range(0, len(a), step):
        x, y = a[part : part + step], b[part : part + step]
        c = size[x]
        whose = np.repeat(np.arange(len(x)), c)
        mine = ids[np.repeat(at[x] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))]
        want = y[whose] * n + mine
        if len(have) and len(want):
            hit = have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want
            out[part : part + step] = np.bincount(whose[hit], minlength=len(x))
    return out


def _roots(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Least member of each group connected by the pairs."""
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(similarity: float, shingle: int, depth: int, trees: int, longest: int):
    """For whole groups, or a pair of blocks (then only links across count): nid, least linked nid, rows linked."""

    def one(table: pa.Table) -> pa.RecordBatch:
        nid, copies, side = (table.column(x).to_numpy() for x in ("nid", "copies", "side"))
        m = len(nid)
        label = np.frombuffer(T.binary(table.column("label").combine_chunks())[0], np.uint8).reshape(m, trees, 2 * longest)[:, :, : 2 * depth]
        keys = np.unique(np.ascontiguousarray(label).view(f"V{2 * depth}").reshape(-1), return_inverse=True)[1].reshape(m, trees)
        owner, ids, size = _sets(table, shingle)
        pairs = candidate_pairs(keys, m * m // 16 + m)
        if pairs is None:
            inter = intersections(owner, ids, m)
            share = np.zeros((m, m), bool)
            for t in range(trees):
                share |= keys[:, t][:, None] == keys[:, t][None, :]
            linked = share & (inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-6) & (inter > 0)
            a, b = np.nonzero(np.triu(linked, 1))
        else:
            a, b = pairs
            inter = pair_intersections(owner, ids, size, a, b)
            linked = (inter >= similarity * (size[a] + size[b] - inter) - 1e-6) & (inter > 0)
            a, b = a[linked], b[linked]
        if side.any():
            across = side[a] != side[b]
            a, b = a[across], b[across]
        links = np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)
        return pa.RecordBatch.from_arrays([pa.array(nid), pa.array(nid[_roots(a, b, m)]), pa.array(links.astype(np.int64))], ["nid", "root", "links"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                g = T.column(batch, "task").to_numpy()
                if held and T.column(held[0], "task")[0].as_py() != g[at]:
                    yield one(_distinct(held))
                    held = []
                stop = at + int(np.argmax(np.append(g[at:] != g[at], True)))
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield one(_distinct(held))

    return run


def _distinct(held: list[pa.RecordBatch]) -> pa.Table:
    """A text that repeated rows of one document brought twice counts once."""
    table = pa.Table.from_batches(held)
    nid = table.column("nid").to_numpy()
    return table.filter(pa.array(np.append(True, nid[1:] != nid[:-1])))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST, shingle: int = SHINGLE, most: int = MOST, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Per row: doc_id, nid (hash of the text), root (of its class), class_id, n_links, n_grams, blank."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("nid"))
    signed = materialise(docs.mapInArrow(_sign(trees, longest, shingle), "doc_id long, nid long, n_words int, n_grams int, label binary"))
    nodes = materialise(signed.where("n_words > 0").groupBy("nid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.first("n_grams").alias("n_grams"), F.first("label").alias("label")))
    edges, depth = walk(nodes, similarity, recall, trees, longest)
    groups = components(edges)
    forget(edges)
    member = groups.join(nodes, groups.u == nodes.nid).select("nid", F.col("v").alias("grp"), "copies", "low", "n_grams", "label")
    sized = member.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g"))
    sized = sized.select("grp", F.ceil(F.greatest(F.col("m") / most, F.col("g") / most_grams)).cast("int").alias("blocks"))
    member = materialise(member.join(sized, "grp"))
    texts = member.join(docs.withColumnRenamed("nid", "n2"), (F.col("nid") == F.col("n2")) & F.col("low").eqNullSafe(F.col("doc_id"))).select("nid", "grp", "copies", "blocks", "label", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    verify = _verify(similarity, shingle, depth, trees, longest)
    # a text is compared in one task with its whole group, or, in a large group, with each block
    block = F.pmod(F.xxhash64("nid", F.lit(7)), F.col("blocks").cast("long")).cast("int")
    tasks = texts.select("*", block.alias("b")).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("o"))
    tasks = tasks.select("nid", "copies", "label", "text", F.xxhash64("grp", F.least("b", "o"), F.greatest("b", "o")).alias("task"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "blocks")
    checked = materialise(tasks.repartition(parts, "task").sortWithinPartitions("task", "nid").select("nid", "copies", "label", "text", "task", "side").mapInArrow(verify, "nid long, root long, links long"))
    links = checked.groupBy("nid").agg(F.sum("links").alias("links"))
    pairs = checked.where("nid <> root").select(F.col("nid").alias("u"), F.col("root").alias("v"))
    roots = components(pairs).select(F.col("u").alias("nid"), F.col("v").alias("root"))
    first = nodes
    nodes = nodes.select("nid", "copies", "low").join(links, "nid", "left").join(roots, "nid", "left").select("nid", "low", F.coalesce("root", "nid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    nodes = materialise(nodes, first, member, checked)
    named = nodes.groupBy("root").agg(F.min("low").alias("class_id"))
    nodes = nodes.join(named, "root").select("nid", "root", "class_id", "n_links")
    out = signed.select("doc_id", "nid", "n_grams", (F.col("n_words") == 0).alias("blank")).join(nodes, "nid", "left")
    return out.select("doc_id", "nid", "root", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_grams", "blank")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class stays, the one with the least doc_id; blank rows all stay. Columns are those of ``docs``."""
    found = near_classes(docs, **options)
    kept = found.where("not blank").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("nid").alias("n"))).alias("s")).select(F.col("s.d").alias("_kv_d"), F.col("s.n").alias("_kv_n"))
    keyed = docs.withColumn("_kv_nid", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_kv_blank", ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    stay = keyed.where("not _kv_blank").join(kept, (F.col("_kv_nid") == F.col("_kv_n")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kv_d")), "left_semi")
    stay = stay.dropDuplicates(["doc_id", "_kv_nid"])
    return stay.union(keyed.where("_kv_blank")).select(*(F.col(f"`{c}`") for c in docs.columns))
