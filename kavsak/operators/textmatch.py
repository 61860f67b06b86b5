"""Distances of one text to many at once: bit-parallel, a word of bits a text, columns shared by texts with a common beginning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from os.path import commonprefix

import numpy as np

#: Texts up to this length have a machine word each; longer ones Python's whole numbers.
WORD = 64


def rounded(x: float) -> float:
    """Two decimals, halves away from zero, as Spark's round."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


@lru_cache(1 << 16)
def combined(text: float, digits: float, weights: tuple[float, float, float]) -> float:
    """``linkage.combine`` of a text score and a digits score, step by step."""
    total = 0.0 + text * weights[0] + digits * weights[1] + 0.0
    weight = 0.0 + weights[0] + weights[1] + 0.0
    return rounded(total / weight) if weight else 0.0


#: Texts that are taken through a table at once; numbers of best ones up to which each is looked for by itself.
BATCH, FEW = 64, 8
#: Most letters that are left off at the end to find the texts whose beginnings are near; how many of these there are at least;
#: pairs of texts that are finished at once; texts that are looked at to tell how many letters are left off.
LAST, NEAR, PAIRS, SOME = 12, 32, 1 << 18, 1024
#: Below any score.
GONE = np.iinfo(np.int32).min


class Many:
    """Texts to be compared with; ``kind`` is levenshtein (distances) or lcs (longest common subsequences)."""

    def __init__(self, texts: list[str], kind: str):
        self.texts, self.n, self.kind = texts, len(texts), kind
        self.length = np.array([len(t) for t in texts], np.int64)

    def values(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each of the sorted ``texts``, its values with all, to be used before the next are asked for."""
        for _, rows in self.batches(texts):
            yield from rows

    def batches(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Some of the sorted ``texts`` and a row for each with its values with all, to be used before the next are asked for.
        What all texts of both sides begin and end with changes no distance and isn't compared."""
        cut, alike = self.cut(texts)
        groups = self._groups([cut(t) for t in self.texts])
        # states that are read, states that are written, and room for a column's steps
        rooms = [None if full.dtype == object else [np.empty((BATCH, len(full)), full.dtype) for _ in range(8)] for _, full, _, _ in groups]
        out = np.zeros((BATCH, self.n), np.int32)
        for i in range(0, len(texts), BATCH):
            some = texts[i : i + BATCH]
            rows = out[: len(some)]
            for (at, *group), room in zip(groups, rooms):
                found = rows if len(at) == self.n else np.empty((len(some), len(at)), np.int32)
                (_long if room is None else _walk)(self.kind, [cut(t) for t in some], *group, found, room)
                if found is not rows:
                    rows[:, at] = found
            if self.kind == "lcs":
                rows += alike
            yield some, rows

    def cut(self, texts: list[str]) -> tuple[Callable[[str], str], int]:
        """What leaves a text without the letters that all of both sides begin and end with, and how many those are."""
        both = [*self.texts, *texts]
        head = len(commonprefix(both))
        tail = min(len(commonprefix([t[head:][::-1] for t in both])), min(map(len, both), default=head) - head)
        return lambda t: t[head : len(t) - tail], head + tail

    def _groups(self, texts: list[str]) -> list[tuple]:
        """Places, whole words of bits, numbers of letters and each letter's bits, of texts that fit a word and of others."""
        length = np.array([len(t) for t in texts], np.int64)
        short, out = length <= WORD, []
        small = np.uint32 if length[short].max(initial=0) <= WORD // 2 else np.uint64
        for which, dtype in ((short, small), (~short, object)):
            at = np.flatnonzero(which)
            if not len(at):
                continue
            codes: dict[str, int] = {}
            masks: list[dict[int, int]] = []
            for k, i in enumerate(at):
                for b, c in enumerate(texts[i]):
                    if c not in codes:
                        codes[c] = len(masks)
                        masks.append({})
                    row = masks[codes[c]]
                    row[k] = row.get(k, 0) | 1 << b
            # the last row is that of letters which no text has
            eq = np.zeros((len(masks) + 1, len(at)), dtype)
            for c, row in enumerate(masks):
                eq[c, list(row)] = np.array(list(row.values()), dtype)
            out.append((at, np.array([(1 << int(m)) - 1 for m in length[at]], dtype), codes, eq))
        return out


def _walk(kind: str, texts: list[str], full: np.ndarray, codes: dict[str, int], eq: np.ndarray, out: np.ndarray, room: list[np.ndarray]) -> None:
    """Values of the texts with all, into ``out``."""
    spare = room[4:]
    bits = np.empty(len(full), np.uint8)
    for i, d, *states in _states(kind, texts, full, codes, eq, room):
        up, down = (np.bitwise_and(x, full, out=y[0]) for x, y in zip(states, spare))
        out[i] = np.bitwise_count(up, out=bits)
        if kind == "levenshtein":
            out[i] -= np.bitwise_count(down, out=bits)
            out[i] += d
        else:
            np.subtract(np.bitwise_count(full), bits, out=out[i], dtype=np.int32)


def _states(kind: str, texts: list[str], full: np.ndarray, codes: dict[str, int], eq: np.ndarray, room: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each text's place, length and states with all, to be used before the next are asked for: column by column, a row of
    states for each different beginning."""
    n, now, then, room = len(texts), room[:2], room[2:4], room[4:]
    length = np.array([len(t) for t in texts])
    longest = int(length.max())
    same = np.array([-1] + [len(commonprefix(x)) for x in zip(texts, texts[1:])])
    letters = np.full((n, longest), len(eq) - 1)
    for i, t in enumerate(texts):
        letters[i, : len(t)] = [codes.get(c, len(eq) - 1) for c in t]
    now[0][0], now[1][0] = full, 0
    node, states = np.zeros(n, np.int64), 1
    step = _column if kind == "levenshtein" else _lcs_column
    ending: dict[int, list[int]] = {}
    for i, d in enumerate(length.tolist()):
        ending.setdefault(d, []).append(i)
    # up to here all begin alike
    alike = int(min(length.min(), same[1:].min(initial=longest)))
    for d in range(longest + 1):
        for i in ending.get(d, ()):
            yield i, d, *(x[node[i]] for x in now)
        if d == longest:
            break
        if d < alike:
            heads = [0]
        else:
            alive = np.flatnonzero(length > d)
            first = same[alive] <= d
            heads = alive[first]
            if len(heads) > states or (node[heads] != np.arange(len(heads))).any():
                for x, y in zip(now, then):
                    x.take(node[heads], axis=0, out=y[: len(heads)], mode="clip")
                now, then = then, now
            states = len(heads)
            node[alive] = np.cumsum(first) - 1
        up, down, hits, *more = (x[:states] for x in (*now, *room))
        eq.take(letters[heads, d], axis=0, out=hits, mode="clip")
        step(up, down, hits, *more)


def _column(up: np.ndarray, down: np.ndarray, eq: np.ndarray, xv: np.ndarray, xh: np.ndarray, ph: np.ndarray) -> None:
    """The next column of the table of distances (Myers): where it grows and where it falls downwards."""
    np.bitwise_or(eq, down, out=xv)
    np.bitwise_and(eq, up, out=xh)
    xh += up
    xh ^= up
    xh |= eq
    np.bitwise_or(xh, up, out=ph)
    np.invert(ph, out=ph)
    ph |= down
    xh &= up
    ph <<= 1
    ph |= 1
    xh <<= 1
    np.bitwise_and(ph, xv, out=down)
    xv |= ph
    np.invert(xv, out=xv)
    np.bitwise_or(xv, xh, out=up)


def _lcs_column(s: np.ndarray, _, eq: np.ndarray, u: np.ndarray, total: np.ndarray, *more) -> None:
    np.bitwise_and(s, eq, out=u)
    np.add(s, u, out=total)
    s -= u
    s |= total


def _long(kind: str, texts: list[str], full: np.ndarray, codes: dict[str, int], eq: np.ndarray, out: np.ndarray, _) -> None:
    """As ``_walk``, for words of any size."""
    count = lambda x: np.array([v.bit_count() for v in x], np.int32)
    stack, before = [(full, full ^ full)], ""
    for i, text in enumerate(texts):
        same = len(commonprefix((before, text)))
        del stack[same + 1 :]
        for c in text[same:]:
            up, down = stack[-1]
            e = eq[codes.get(c, -1)]
            if kind == "levenshtein":
                xh = (((e & up) + up) ^ up) | e
                ph = (down | ~(xh | up)) << 1 | 1
                stack.append(((up & xh) << 1 | ~(e | down | ph), ph & (e | down)))
            else:
                u = up & e
                stack.append(((up + u) | (up - u), down))
        up, down = stack[-1]
        out[i] = len(text) + count(up & full) - count(down & full) if kind == "levenshtein" else count(full) - count(up & full)
        before = text


def runs(text: str) -> set[str]:
    return set(re.findall(r"[0-9]+", text))


#: Pairs that are taken through a table of stretches at once.
CELLS = 1 << 15


class Partials:
    """``linkage.partial_ratio`` of texts with many, those of like lengths at once. The states after a stretch's last letter
    hold the values of its beginnings too; its ends are the beginnings of the texts read backwards."""

    def __init__(self, texts: list[str]):
        self.n, self.groups = len(texts), []
        for length, at in sorted(_by_length(texts).items()):
            codes: dict[str, int] = {}
            for i in at:
                for c in texts[i]:
                    codes.setdefault(c, len(codes))
            dtype = np.uint64 if length <= WORD else object
            both = []
            for way in (1, -1):
                # the last row is that of letters which no text has
                rows = [[0] * len(at) for _ in range(len(codes) + 1)]
                for k, i in enumerate(at):
                    for b, c in enumerate(texts[i][::way]):
                        rows[codes[c]][k] |= 1 << b
                both.append(np.array(rows, dtype).reshape(len(rows), len(at)))
            self.groups.append((length, np.array(at), codes, *both))

    def of(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""
        out = np.zeros((len(texts), self.n))
        for length, rows in _by_length(texts).items():
            for size, at, codes, ahead, back in self.groups:
                letters = np.array([[codes.get(c, len(codes)) for c in texts[i]] for i in rows], np.int64).reshape(len(rows), length)
                step = max(1, CELLS // len(at))
                for i in range(0, len(rows), step):
                    out[np.ix_(rows[i : i + step], at)] = self._best(letters[i : i + step], size, ahead, back)
        return out

    def _best(self, letters: np.ndarray, size: int, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        count, length = letters.shape
        n = min(length, size)
        if not n:
            return np.full((count, ahead.shape[1]), 0.0 if length or size else 100.0)
        dtype = ahead.dtype
        bits = lambda k: dtype.type((1 << k) - 1) if dtype != object else (1 << k) - 1
        ones = (lambda x: np.bitwise_count(x)) if dtype != object else (lambda x: np.array([v.bit_count() for v in x.flat], np.int64).reshape(x.shape))
        full = bits(n)
        most, best = np.zeros((count, ahead.shape[1]), np.int64), None

        def run(masks, columns, seen=lambda k, s: None):
            s = np.full((count, masks.shape[1]), full, dtype)
            for k, column in enumerate(columns, 1):
                u = masks.take(column, axis=0)
                u &= s
                more = s + u
                s -= u
                s |= more
                seen(k, s)
            return s

        def begun(k, s):
            """A stretch of k letters at an end: ``s`` has its value."""
            nonlocal best
            if 200.0 * k / (n + k) > least:
                best = np.maximum(best, 200.0 * (k - ones(s & bits(k)).astype(np.int64)) / (n + k) if length <= size else 200.0 * (n - ones(s & full).astype(np.int64)) / (n + k))

        letters = letters.T
        for i in range(abs(length - size) + 1):
            if length <= size:
                s = run((ahead >> (dtype.type(i) if dtype != object else i)) & full, letters)
            else:
                s = run(ahead, letters[i : i + n])
            np.maximum(most, n - ones(s & full).astype(np.int64), out=most)
        best = 200.0 * most / (n + n)
        least = float(best.min())
        for masks, columns in ((ahead, letters), (back, letters[::-1])):
            if length <= size:
                s = run(masks & full, columns)
                for k in range(1, n):
                    begun(k, s)
            else:
                run(masks, columns[: n - 1], begun)
        return best


def _by_length(texts: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        out.setdefault(len(t), []).append(i)
    return out


class Scores:
    """Scores of texts with many: ``scorer`` is levenshtein, ratio or partial_ratio, weighed with whether they share a run of
    digits."""

    def __init__(self, texts: list[str], scorer: str, weights: tuple[float, float, float]):
        self.many = Many(texts, "levenshtein" if scorer == "levenshtein" else "lcs")
        self.partials = Partials(texts) if scorer == "partial_ratio" else None
        self.weights, self.holds = weights, {}
        found: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            for r in runs(t):
                found.setdefault(r, []).append(i)
        for r, at in found.items():
            self.holds[r] = np.zeros(len(texts), bool)
            self.holds[r][at] = True
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def text(self, value: int, a: int, b: int) -> float:
        if self.many.kind == "levenshtein":
            return 100.0 * (1 - value / max(a, b, 1))
        return 200.0 * value / (a + b) if a or b else 100.0

    def table(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores, in hundredths, of a text of length ``a`` by the other's length, the value and whether digits are shared; and
        the place at which the scores with each of the others begin."""
        if a not in self.tables:
            lengths = np.unique(self.many.length)
            most = max(a, int(lengths[-1])) + 1
            out = np.zeros((len(lengths), most, 2), np.int32)
            for i, b in enumerate(map(int, lengths)):
                for v in range(max(a, b) + 1 if self.many.kind == "levenshtein" else min(a, b) + 1):
                    for d in (0, 1):
                        out[i, v, d] = round(combined(self.text(v, a, b), 100.0 * d, self.weights) * 100)
            self.tables[a] = out.ravel(), np.searchsorted(lengths, self.many.length).astype(np.int32) * (most * 2)
        return self.tables[a]

    def best(self, texts: list[str], least: float, k: int) -> Iterator[tuple[str, list[int], list[float]]]:
        """For each of the sorted ``texts``, the places of the k best of at least ``least``, ties in their order, and their scores."""
        need = int(least * 100) - 2
        while need / 100 < least:
            need += 1
        if not self.partials and self.many.kind == "levenshtein" and k <= FEW:
            near = Near(self, texts, need, k)
            found = near.found()
            left = [t for t, x in zip(texts, found) if x is None]
            rest = self._ranked(left, need, k)
            for text, x in zip(texts, found):
                yield next(rest) if x is None else (text, *x)
        else:
            yield from self._ranked(texts, need, k)

    def _ranked(self, texts: list[str], need: int, k: int) -> Iterator[tuple[str, list[int], list[float]]]:
        """As ``best``, from the scores with all."""
        for text, score in self._partial(texts) if self.partials else self._whole(texts):
            if k <= FEW:
                places, found = [], []
                for _ in range(min(k, len(score))):
                    i = int(score.argmax())
                    x = int(score[i])
                    if x < need or x == GONE:
                        break
                    places.append(i)
                    found.append(x / 100)
                    score[i] = GONE
            else:
                i = np.flatnonzero(score >= need)
                if len(i) > k:
                    # not below the k-th best
                    i = i[score[i] >= np.partition(score[i], len(i) - k)[len(i) - k]]
                i = i[np.argsort(-score[i], kind="stable")[:k]]
                places, found = i.tolist(), (score[i] / 100).tolist()
            yield text, places, found

    def _shared(self, text: str) -> np.ndarray | None:
        """Where a run of digits is shared."""
        held = [self.holds[r] for r in runs(text) if r in self.holds]
        return (np.logical_or.reduce(held) if len(held) > 2 else held[0] | held[-1]) if held else None

    def _whole(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        at = np.empty(self.many.n, np.int32)
        for some, values in self.many.batches(texts):
            values *= 2
            for text, value in zip(some, values):
                table, begin = self.table(len(text))
                np.add(value, begin, out=at)
                shared = self._shared(text)
                if shared is not None:
                    at += shared
                yield text, table.take(at)

    def _partial(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        step = 4 * BATCH
        for i in range(0, len(texts), step):
            for text, x in zip(texts[i : i + step], self.partials.of(texts[i : i + step])):
                shared = self._shared(text)
                score = combine(x, np.zeros(len(x), bool) if shared is None else shared, None, self.weights)
                # few different ones
                values, place = np.unique(score, return_inverse=True)
                yield text, np.rint(rounds(values) * 100).astype(np.int32)[place]


class Near:
    """The best of ``Scores`` by distance without the distances with all. Texts without their last letters are fewer; the
    distance of two texts is at least that of their beginnings, which bounds the score of each pair. The pairs
    with the highest bounds are finished from the states of the beginnings; a text whose k best aren't above the bounds of all
    other pairs has to be compared with all."""

    def __init__(self, scores: Scores, texts: list[str], need: int, k: int):
        self.scores, self.texts, self.need, self.k = scores, texts, need, k
        self.n, self.many = scores.many.n, max(NEAR, 8 * k)

    def found(self) -> list[tuple[list[int], list[float]] | None]:
        """Places and scores of each text; None if it has to be compared with all."""
        self.out: list[tuple[list[int], list[float]] | None] = [None] * len(self.texts)
        if self.n < 4 * self.many or not self.texts:
            return self.out
        cut, _ = self.scores.many.cut(self.texts)
        texts = [cut(t) for t in self.texts]
        last = _last(texts)
        groups = self.scores.many._groups([cut(t) for t in self.scores.many.texts]) if last else []
        if len(groups) != 1 or groups[0][1].dtype == object:
            return self.out
        _, self.full, self.codes, self.eq = groups[0]
        self.length = np.bitwise_count(self.full).astype(np.int32)
        # tables one after the other, and where the scores with each of the others begin
        lengths = sorted({len(t) for t in self.texts})
        each = [self.scores.table(a) for a in lengths]
        self.table = np.concatenate([x for x, _ in each])
        self.begin = np.array([b + at for (_, b), at in zip(each, np.cumsum([0] + [len(x) for x, _ in each]).tolist())], np.int32)
        row = {a: i for i, a in enumerate(lengths)}
        self.row = np.array([row[len(t)] for t in self.texts])
        # places of the texts' runs of digits among all; the last holds none
        code = {r: i for i, r in enumerate(self.scores.holds)}
        mine = [[code[r] for r in runs(t) if r in code] for t in self.texts]
        self.runs = np.full((len(texts), max(map(len, mine))), len(code))
        for i, x in enumerate(mine):
            self.runs[i, : len(x)] = x
        self.holds = np.array([*self.scores.holds.values(), np.zeros(self.n, bool)])
        heads: dict[int, dict[str, list[int]]] = {}
        for i, t in enumerate(texts):
            size = min(last, len(t))
            heads.setdefault(size, {}).setdefault(t[: len(t) - size], []).append(i)
        room = [np.empty((BATCH, self.n), self.full.dtype) for _ in range(10)]
        for size, of in heads.items():
            self.size, self.tails = size, {i: texts[i][len(texts[i]) - size :] for at in of.values() for i in at}
            names = sorted(of)
            for i in range(0, len(names), BATCH):
                self._begun(names[i : i + BATCH], of, room)
        return self.out

    def _begun(self, heads: list[str], of: dict[str, list[int]], room: list[np.ndarray]) -> None:
        """The texts with these beginnings."""
        one, dtype = self.full.dtype.type(1), self.full.dtype
        over = self.length - self.size
        # a distance begins at the places before the last letters of the other text, too
        low = (one << np.maximum(over, 0).astype(dtype)) - one
        if (over >= 8 * dtype.itemsize).any():
            low[over >= 8 * dtype.itemsize] = self.full[over >= 8 * dtype.itemsize]
        more = np.maximum(-over, 0)
        states, jobs, waiting = room[8:], [], 0
        for i, _, *both in _states("levenshtein", heads, self.full, self.codes, self.eq, room[:8]):
            states[0][i], states[1][i] = both
        up, down = (np.bitwise_and(x[: len(heads)], low, out=y[: len(heads)]) for x, y in zip(states, room))
        least = np.bitwise_count(up).astype(np.int32)
        least -= np.bitwise_count(down)
        least += more + np.array([[len(h)] for h in heads], np.int32)
        # the scores if digits are shared
        least *= 2
        least += 1
        least += self.begin[self.row[[of[h][0] for h in heads]]]
        most = self.table.take(least)
        bound = np.maximum(np.partition(most, self.n - self.many, axis=1)[:, self.n - self.many], self.need)
        near = most >= bound[:, None]
        beyond = np.where(near, GONE, most).max(axis=1).tolist()
        for i, head in enumerate(heads):
            chosen = np.flatnonzero(near[i])
            if 4 * len(chosen) <= self.n:
                jobs.append((i, of[head], chosen, beyond[i]))
        for i, at, chosen, beyond in jobs:
            step = max(1, PAIRS // max(1, len(chosen)))
            for j in range(0, len(at), step):
                part = (i, at[j : j + step], chosen, beyond)
                size = len(part[1]) * len(chosen)
                if waiting and waiting[0] + size > PAIRS:
                    self._finished(waiting[1], heads, states)
                    waiting = 0
                waiting = (waiting[0] + size, [*waiting[1], part]) if waiting else (size, [part])
        if waiting:
            self._finished(waiting[1], heads, states)

    def _finished(self, jobs: list[tuple[int, list[int], np.ndarray, int]], heads: list[str], states: list[np.ndarray]) -> None:
        """The rest of the pairs of texts with the places chosen for their beginnings, all at once: a stretch of pairs for each
        different beginning."""
        at = np.array([i for _, x, _, _ in jobs for i in x])
        job = np.repeat(np.arange(len(jobs)), [len(x) for _, x, _, _ in jobs])
        tails = [self.tails[i] for i in at.tolist()]
        letters = np.array([[self.codes.get(c, len(self.eq) - 1) for c in t] for t in tails], np.int64).reshape(len(tails), self.size)
        same = np.array([-1] + [len(commonprefix(x)) for x in zip(tails, tails[1:])])
        same[1:][job[1:] != job[:-1]] = -1
        count = np.array([len(c) for _, _, c, _ in jobs])
        first = np.cumsum(count) - count
        place = np.concatenate([c for _, _, c, _ in jobs])
        pairs = np.repeat([i * self.n for i, *_ in jobs], count) + place
        up, down = (x.ravel().take(pairs)[None] for x in states)
        node = job
        for d in range(self.size + 1):
            # a stretch for each text in the end
            new = same <= d if d < self.size else np.ones(len(at), bool)
            parent = node[new]
            if len(parent) > len(count):
                pairs = _stretches(first[parent], count[parent])
                up, down, place = up.take(pairs, axis=1), down.take(pairs, axis=1), place.take(pairs)
                count = count[parent]
                first = np.cumsum(count) - count
            if d == self.size:
                break
            node = np.cumsum(new) - 1
            hits = self.eq.ravel().take(np.repeat(letters[new, d] * self.n, count) + place)[None]
            _column(up, down, hits, *(np.empty_like(up) for _ in range(3)))
        full, text = self.full.take(place), np.repeat(np.arange(len(at)), count)
        value = np.bitwise_count(up[0] & full).astype(np.int64)
        value -= np.bitwise_count(down[0] & full)
        value += np.repeat([len(heads[jobs[j][0]]) + self.size for j in job], count)
        shared = np.zeros(len(place), bool)
        for x in self.runs[at].T:
            shared |= self.holds.ravel().take(np.repeat(x * self.n, count) + place)
        value *= 2
        value += shared
        value += self.begin.ravel().take(np.repeat(self.row[at] * self.n, count) + place)
        score = self.table.take(value).astype(np.int64)
        # by text, the best first, ties by place
        top, bits = int(self.table.max()), self.n.bit_length()
        more, ok = top.bit_length(), score >= self.need
        order = np.sort((((text[ok] << more) + (top - score[ok])) << bits) + place[ok])
        text, score, place = order >> bits + more, top - (order >> bits & (1 << more) - 1), order & (1 << bits) - 1
        begin = np.searchsorted(text, np.arange(len(at) + 1))
        size = np.minimum(np.diff(begin), self.k)
        for j, (i, a, b) in enumerate(zip(at.tolist(), begin.tolist(), size.tolist())):
            found = score[a : a + b].tolist()
            if jobs[job[j]][3] < (found[-1] if b == self.k else self.need):
                self.out[i] = place[a : a + b].tolist(), [x / 100 for x in found]


def _stretches(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _last(texts: list[str]) -> int:
    """How many letters to leave off at the end: the least that leaves half as many texts, and more while that leaves about as
    many; 0 if none does. It is told by texts that follow each other."""
    texts = texts[max(0, len(texts) - SOME) // 2 :][:SOME]
    sizes = [len({t[: max(0, len(t) - n)] for t in texts}) for n in range(1, LAST + 1)]
    least = next((i for i, x in enumerate(sizes) if 2 * x <= len(texts)), None)
    return 0 if least is None else max(i for i, x in enumerate(sizes) if 5 * x >= 4 * sizes[least]) + 1


class TokenSets:
    """``linkage.token_set_ratio`` of a text with many. Each text is the sorted row of its different words, backwards; the words
    that both have are taken out of the bits of one and out of the letters of the other, pair by pair."""

    def __init__(self, texts: list[str]):
        words = [sorted(set(t.split())) for t in texts]
        self.rows, self.many = [" ".join(w) for w in words], None
        longest = max(map(len, self.rows), default=0)
        self.dtype = np.uint64 if longest < WORD else object
        n = len(texts)
        blank = lambda: np.zeros(n, self.dtype) if self.dtype is not object else np.array([0] * n, object)
        self.zero, self.bits, self.eq = blank(), {}, {}
        self.all, self.words, self.chars = blank(), np.array([len(w) for w in words]), np.array([sum(map(len, w)) for w in words])
        for i, row in enumerate(words):
            at = 0
            for w in reversed(row):
                # the word's letters and the blank after it, in bits from the end of the text
                self.bits.setdefault(w, blank())[i] = ((1 << len(w) + 1) - 1) << at
                for c in reversed(w):
                    x = self.eq.setdefault(c, blank())
                    x[i] = int(x[i]) | 1 << at
                    at += 1
                x = self.eq.setdefault(" ", blank())
                x[i] = int(x[i]) | 1 << at
                at += 1
            self.all[i] = (1 << at) - 1

    def count(self, x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x).astype(np.int64) if self.dtype is not object else np.array([v.bit_count() for v in x], np.int64)

    def of(self, text: str) -> np.ndarray:
        words = sorted(set(text.split()))
        if not words:
            return np.zeros(len(self.all))
        keep, n_both, c_both = self.all.copy(), np.zeros(len(self.all), np.int64), np.zeros(len(self.all), np.int64)
        mine = []
        for w in words:
            held = self.bits.get(w)
            has = held != 0 if held is not None else np.zeros(len(self.all), bool)
            if held is not None:
                keep &= ~held
                n_both += has
                c_both += has * len(w)
            mine.append(has)
        # the first word left stands last in the bits; the blank after it, above all others, isn't part of the text
        size_l, size_r = len(words) - n_both, self.words - n_both
        left, right = sum(map(len, words)) - c_both + np.maximum(size_l - 1, 0), self.chars - c_both + np.maximum(size_r - 1, 0)
        both = c_both + np.maximum(n_both - 1, 0)
        keep = self._below(keep)
        # bits taken out match nothing but carry on
        s, later = self.all, np.zeros(len(self.all), bool)
        for w, has in zip(reversed(words), reversed(mine)):
            for c, who in [(" ", ~has & later), *((c, ~has) for c in reversed(w))]:
                eq = self.eq.get(c)
                if eq is None:
                    continue
                u = s & np.where(who, eq & keep, self.zero)
                s = (s + u) | (s - u)
            later |= ~has
        lcs = self.count(self.all) - self.count(s & self.all)
        some = n_both > 0
        one, two = (np.where(some, both + (x > 0) + x, x) for x in (left, right))
        lcs = np.where(some, lcs + both + 1, lcs)
        ratio = lambda v, a, b: 200.0 * v / np.maximum(a + b, 1)
        best = ratio(lcs, one, two)
        best = np.where(some, np.maximum(best, np.maximum(ratio(both, both, one), ratio(both, both, two))), best)
        best = np.where(some & ((left == 0) | (right == 0)), 100.0, best)
        return np.where(self.words > 0, best, 0.0)

    def _below(self, x: np.ndarray) -> np.ndarray:
        """Without the highest bit."""
        if self.dtype is object:
            return np.array([v & ~(1 << v.bit_length() - 1) if v else 0 for v in x], object)
        y = x.copy()
        for k in (1, 2, 4, 8, 16, 32):
            y |= y >> np.uint64(k)
        return x & (y >> np.uint64(1))


class Parts:
    """Text scores of each of the sorted texts with many, and whether they share a run of digits."""

    def __init__(self, texts: list[str], scorer: str):
        self.scorer = scorer
        self.scores = Scores(texts, scorer, (1.0, 0.0, 0.0))
        self.sets = TokenSets(texts) if scorer == "token_set_ratio" else None

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        many = self.scores.many
        values = many.values(texts) if self.sets is None else (self.sets.of(t) for t in texts)
        for text, x in zip(texts, values):
            if self.scorer == "levenshtein":
                x = 100.0 * (1 - x / np.maximum(np.maximum(many.length, len(text)), 1))
            elif self.sets is None:
                both = many.length + len(text)
                x = np.where(both > 0, 200.0 * x / np.maximum(both, 1), 100.0)
            shared = np.zeros(many.n, bool)
            for r in runs(text):
                if r in self.scores.holds:
                    shared |= self.scores.holds[r]
            yield x, shared


def rounds(x: np.ndarray) -> np.ndarray:
    """``rounded`` of many."""
    y = x * 100
    out = np.round(y) / 100
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = rounded(float(x[i]))
    return out


def combine(text: np.ndarray, digits: np.ndarray, geo: np.ndarray | None, weights: tuple[float, float, float]) -> np.ndarray:
    """``linkage.combine`` of many, before it is rounded; a missing geo score is NaN or None."""
    t, d, g = weights
    total, weight = 0.0 + text * t + np.where(digits, 100.0, 0.0) * d, 0.0 + t + d
    if geo is None:
        return total / weight
    there = ~np.isnan(geo)
    return (total + np.where(there, geo * g, 0.0)) / np.where(there, weight + g, weight)
