"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def suffix(docs, width=200):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for (doc, _), r in zip(docs, raw):
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((doc, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def substring(docs, width=50):
    ws = [words(t) for _, t in docs]
    least: dict[tuple, int] = {}
    for (doc, _), w in zip(docs, ws):
        if doc is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(least.get(k, doc), doc)
    out = []
    for (doc, _), w in zip(docs, ws):
        gone = [False] * len(w)
        if doc is not None:
            for i in range(len(w) - width + 1):
                if least[tuple(w[i : i + width])] < doc:
                    gone[i : i + width] = [True] * width
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def near(docs, similarity=0.8, n=5):
    """(doc_id, class_id, n_links) of each row."""
    ws = [words(t) for _, t in docs]
    sets = [frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in ws]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in inverted[g]).items():
            if i != j and c >= similarity * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i].add(j)
    same = defaultdict(list)
    for i, (_, t) in enumerate(docs):
        if ws[i]:
            same[t].append(i)
    for group in same.values():
        for i in group:
            links[i] |= set(group) - {i}
    root: dict[int, int] = {}
    for i in range(len(docs)):
        if i not in root:
            stack = [i]
            root[i] = i
            while stack:
                for j in links[stack.pop()]:
                    if j not in root:
                        root[j] = i
                        stack.append(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[root[i]] = min(low.get(root[i], doc), doc)
    return [(doc, low.get(root[i]), len(links[i])) for i, (doc, _) in enumerate(docs)]


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii(docs):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base spans)"""
    out = []
    for doc, t in docs:
        found = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m[0])]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        n = Counter(k for k, *_ in found)
        out.append((doc, n["email"], n["ip"], n["card"], n["phone"], sha(listed.encode()), listed))
    return out


def rules(docs):
    out = []
    for doc, t in docs:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


def targets(sizes: dict, weights=(3.0, 1.0, 2.0), total=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        rest = [s for s in order if s not in full]
        left = total * sum(sizes.values()) - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}
