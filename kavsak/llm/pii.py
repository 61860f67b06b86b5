"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans, which may overlap, for each kind. What speaks for a candidate without any label
(a base match; a host with a domain; a card number of 13 to 19 digits that passes Luhn; a phone number of fitting length
after a plus, a bracket or a word such as "tel") makes it a supported one. Format and context features, binned, describe
all candidates, and boosted trees of depth two learn support from them on the counts of feature cells, whose number is
bounded by the bins, whatever the input. Half of the candidates, by hash, teach the trees; on the other half each kind's
threshold is the least score above which the share of supported candidates, counted with one imagined candidate of just
that share, reaches ``precision``. Candidates over the threshold that touch no base span are added, so obfuscated mail
addresses, cards with other separators or lengths and national phone numbers are found too; base spans always stay. A kind
without held-out candidates gets none added.

Null texts count as empty and have no spans. Repeated rows get equal spans. Extra columns pass through in ``redact`` and
are ignored in ``find``. An empty table gives an empty result; without candidates nothing is learned or added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise

#: Patterns of the kinds. Possessive repeats match what the plain ones do, without backtracking.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What proposes further spans of the kind.
AT, DOT = r"\x20?(?:@|\(at\)|\[at\])\x20?", r"(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)"
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,}+",
    "phone": r"[+(]?[0-9][\x20().0-9-]{5,}[0-9]",
}
KINDS = tuple(BASE)
#: Words before a span that speak of its kind.
CONTEXT = {
    "email": "mail|email|contact|write|address|from|to",
    "ip": "ip|host|server|address|from|to",
    "card": "card|visa|mastercard|amex|account|payment",
    "phone": "call|phone|tel|telephone|telefon|mobile|cell|fax|contact",
}
#: How far before a span such a word may begin.
NEAR = 24
PRECISION, TREES, RATE = 0.995, 30, 0.3
#: Bins of the features, which bound the number of cells.
FEATURES = {"kind": 4, "digits": 6, "length": 5, "groups": 6, "seps": 4, "plus": 3, "before": 3, "after": 3, "context": 3, "check": 2}
#: Matches whose places are summed up at once: an array grows by copying.
STEP = 256


NONE = "cast(array() as array<struct<s:int,e:int,m:string,l:string,r:string>>)"


def _placed(pieces: Column) -> Column:
    """(at, out): the length of ``pieces`` (gap, m, r) in code points, and their matches as structs (s, e, m, l, r)."""
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("out")),
        lambda a, x: F.struct(
            (a.at + F.length(x.gap) + F.coalesce(F.length(x.m), F.lit(0))).alias("at"),
            F.when(x.m.isNull(), a.out).otherwise(F.concat(a.out, F.array(F.struct((a.at + F.length(x.gap)).alias("s"), (a.at + F.length(x.gap) + F.length(x.m)).alias("e"), x.m.alias("m"), F.right(x.gap, F.lit(NEAR)).alias("l"), x.r.alias("r"))))).alias("out"),
        ),
    )


def _found(text: Column, pattern: str) -> Column:
    """Matches as structs (s, e, m, l, r), from the pieces between them: positions are code points, l is what stands before
    the match (back to the match before it), r the character behind it. Long texts are not searched again for either."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def many(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int")), lambda i: _placed(F.slice(all_, i * STEP + 1, F.lit(STEP))))
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.at)))
        moved = F.zip_with(parts, starts, lambda p, at: F.transform(p.out, lambda x: F.struct((x.s + at).alias("s"), (x.e + at).alias("e"), x.m.alias("m"), x.l.alias("l"), x.r.alias("r"))))
        return F.flatten(F.filter(moved, lambda x: x.isNotNull()))

    near = lambda all_: F.transform(all_, lambda x, i: F.struct(x.m.alias("m"), x.gap.alias("gap"), F.left(F.coalesce(F.get(all_, i + 1).gap, F.lit("")), F.lit(1)).alias("r")))
    pieces = F.element_at(F.transform(F.array(pieces), near), 1)
    both = F.element_at(F.transform(F.array(pieces), lambda all_: F.when(F.size(all_) <= STEP, _placed(all_).out).otherwise(many(all_))), 1)
    return F.when(text.rlike(pattern), both).otherwise(F.expr(NONE))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x.m)


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.s.alias("s"), x.e.alias("e"))


def _of(kind: str):
    return lambda x: x.kind == kind


def _level(x: Column, *edges: int) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def _guarded(kind: str, text: Column, pattern: str) -> Column:
    none = F.expr(NONE)
    need = F.contains(text, F.lit("@")) | (F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]"))) if kind == "email" else text.rlike("[0-9][0-9.\\x20()-]{4}")
    return F.when(need, _found(text, pattern)).otherwise(none)


def _masked(text: Column, kind: str) -> Column:
    """``text`` with valid base matches of the kind overwritten, so that nothing matches there."""
    hide = lambda x: F.when(x.m.isNull(), "").when(_valid(kind, x.m), F.repeat(F.lit("\x01"), F.length(x.m))).otherwise(x.m)
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(BASE[kind]), 0).alias("m"), F.split(text, BASE[kind], -1).alias("gap"))
    return F.array_join(F.transform(pieces, lambda x: F.concat(x.gap, hide(x))), "")


def spans(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``_kv_base`` (kind, s, e) and ``_kv_wide``, further candidates (kind, s, e, ok and features),
    and ``_kv_sure``, the same of the base spans."""
    df = docs.withColumn("_kv_t", F.coalesce(F.col("text"), F.lit("")))
    text = F.col("_kv_t")
    df = df.withColumns({f"_kv_{k}": F.filter(_guarded(k, text, BASE[k]), _checked(k)) for k in KINDS}).withColumn("_kv_x", text)
    for k in KINDS:
        df = df.withColumn("_kv_x", F.when(F.size(f"_kv_{k}") > 0, _masked(F.col("_kv_x"), k)).otherwise(F.col("_kv_x")))
    df = df.withColumns({f"_kv_w_{k}": _guarded(k, F.col("_kv_x"), WIDE[k]) for k in KINDS})
    base = F.concat(*(F.transform(f"_kv_{k}", _named(k)) for k in KINDS))

    def described(k: str, sure: bool):
        def one(x: Column) -> Column:
            m, digits = x.m, F.length(_digits(x.m))
            prev, after, left = F.right(x.l, F.lit(1)), x.r, F.lower(x.l)
            says = lambda words: left.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
            context = F.when(says(CONTEXT[k]), 2).when(says("|".join(CONTEXT.values())), 1).otherwise(0)
            side = lambda c: F.when(c == "", 0).when(c.rlike(r"[A-Za-z0-9_./=\"'-]"), 2).otherwise(1)
            plus = F.when(F.startswith(m, F.lit("+")), 2).when(F.startswith(m, F.lit("(")), 1).otherwise(0)
            fits = {
                "email": m.rlike(rf"{DOT}[A-Za-z]{{2,}}$"),
                "ip": _valid("ip", m) & (side(prev) < 2),
                "card": digits.between(13, 19) & F.call_function("luhn_check", _digits(m)),
                "phone": digits.between(8, 15) & ~m.rlike(r"^[0-9]+(\.[0-9]+){3}$"),
            }[k]
            features = {
                "kind": F.lit(KINDS.index(k)),
                "digits": _level(digits, 4, 8, 11, 16, 20),
                "length": _level(F.length(m), 8, 13, 17, 25),
                "groups": _level(F.size(F.split(m, "[^A-Za-z0-9]+")), 2, 3, 4, 5, 6),
                "seps": F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike(r"\x20"), 1).when(m.rlike("-"), 2).otherwise(3),
                "plus": plus,
                "before": side(prev),
                "after": side(after),
                "context": context,
                "check": fits.cast("int"),
            }
            ok = F.lit(True) if sure else (fits & ((plus > 0) | (context == 2))) if k == "phone" else fits
            return F.struct(F.lit(k).alias("kind"), x.s.alias("s"), x.e.alias("e"), ok.alias("ok"), F.pmod(F.xxhash64(m), F.lit(2)).alias("half"), *(v.cast("int").alias(n) for n, v in features.items() if n != "kind"))

        return one

    every = {"_kv_wide": ("_kv_w_", False), "_kv_sure": ("_kv_", True)}
    df = df.withColumns({"_kv_base": base} | {name: F.concat(*(F.transform(f"{at}{k}", described(k, sure)) for k in KINDS)) for name, (at, sure) in every.items()})
    return df.drop("_kv_t", "_kv_x", *(f"_kv_{k}" for k in KINDS), *(f"_kv_w_{k}" for k in KINDS))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int = 2):
    """A tree of depth two by Newton gains: (feature, at least, left, right) or a leaf's value."""
    value = -grad.sum() / (hess.sum() + 1.0)
    if depth == 0:
        return value
    best, gain = None, 1e-6
    for f, bins in enumerate(FEATURES.values()):
        for cut in range(1, bins):
            left = x[:, f] < cut
            if left.any() and not left.all():
                parts = [grad[s].sum() ** 2 / (hess[s].sum() + 1.0) for s in (left, ~left)]
                if (g := sum(parts) - grad.sum() ** 2 / (hess.sum() + 1.0)) > gain:
                    best, gain = (f, cut, left), g
    if best is None:
        return value
    f, cut, left = best
    return f, cut, _tree(x[left], grad[left], hess[left], depth - 1), _tree(x[~left], grad[~left], hess[~left], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] < cut, _apply(left, x), _apply(right, x))


def boost(cells: np.ndarray, n: np.ndarray, yes: np.ndarray, trees: int = TREES, rate: float = RATE) -> tuple[float, list]:
    """Boosted trees for the log-odds of confirmation, on cells with n candidates of which ``yes`` are confirmed."""
    start = math.log((yes.sum() + 1) / (n.sum() - yes.sum() + 1))
    f, grown = np.full(len(n), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = _tree(cells, n * p - yes, n * p * (1 - p))
        grown.append(tree)
        f = f + rate * _apply(tree, cells)
    return start, grown


def learn(found: DataFrame, precision: float = PRECISION) -> dict:
    """Trees from one half of the candidates, thresholds from the other; the collected table is bounded by the bins."""
    names = list(FEATURES)
    rows = found.select(F.explode(F.concat("_kv_wide", "_kv_sure")).alias("c")).select(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("c.kind")).cast("int").alias("kind"), *(f"c.{n}" for n in names if n != "kind"), "c.half", F.col("c.ok").cast("int").alias("ok"))
    rows = rows.groupBy(*names, "half").agg(F.count("*").alias("n"), F.sum("ok").alias("yes")).collect()
    x = np.array([[r["kind"] - 1, *(r[n] for n in names if n != "kind")] for r in rows], np.int64).reshape(-1, len(names))
    n, yes, half = (np.array([r[c] for r in rows], np.float64) for c in ("n", "yes", "half"))
    order = np.lexsort(x.T[::-1])
    x, n, yes, half = x[order], n[order], yes[order], half[order]
    start, trees = boost(x[half == 0], n[half == 0], yes[half == 0])
    f = start + RATE * sum((_apply(t, x) for t in trees), np.zeros(len(x)))
    limits = {}
    for k, kind in enumerate(KINDS):
        held = np.flatnonzero((half == 1) & (x[:, 0] == k))
        held = held[np.argsort(-f[held], kind="stable")]
        share = (np.cumsum(yes[held]) + precision) / (np.cumsum(n[held]) + 1)
        # cells of one score stay together
        good = np.flatnonzero((share >= precision - 1e-12) & np.append(f[held][1:] < f[held][:-1], True)[: len(held)])
        limits[kind] = float(f[held[good[-1]]]) if len(good) else math.inf
    return {"start": start, "trees": trees, "limits": limits}


def _score(model: dict, c: Column) -> Column:
    names = list(FEATURES)

    def node(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, left, right = tree
        if names[f] == "kind":
            test = F.array_position(F.array(*(F.lit(k) for k in KINDS)), c.kind) - 1 < cut
        else:
            test = c.getField(names[f]) < cut
        return F.when(test, node(left)).otherwise(node(right))

    out = F.lit(model["start"])
    for t in model["trees"]:
        out = out + RATE * node(t)
    return out


def added(model: dict) -> Column:
    """Candidates over their kind's threshold that touch no base span nor an added one that begins before them."""
    limit = F.lit(math.inf)
    kinds = lambda c: F.when(c.kind == "email", model["limits"]["email"]).when(c.kind == "ip", model["limits"]["ip"]).when(c.kind == "card", model["limits"]["card"]).when(c.kind == "phone", model["limits"]["phone"]).otherwise(limit)
    picked = F.filter("_kv_wide", lambda c: (_score(model, c) >= kinds(c)) & ~F.exists("_kv_base", lambda b: (b.s < c.e) & (c.s < b.e)))
    picked = F.sort_array(F.transform(picked, lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), c.kind.alias("kind"))))
    none = "cast(array() as array<struct<kind:string,s:int,e:int>>)"

    def sweep(some: Column, end: Column) -> Column:
        """Those that begin at or after the end of the one kept before them, and the last end."""
        keep = lambda c: F.array(F.struct(c.kind.alias("kind"), c.s.alias("s"), c.e.alias("e")))
        return F.aggregate(some, F.struct(end.alias("end"), F.expr(none).alias("out")), lambda a, c: F.when(c.s < a.end, a).otherwise(F.struct(c.e.alias("end"), F.concat(a.out, keep(c)).alias("out"))))

    def all_of(many: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(many) - 1) / STEP).cast("int")), lambda i: F.slice(many, i * STEP + 1, F.lit(STEP)))

        def add(a: Column, part: Column) -> Column:
            return F.element_at(F.transform(F.array(sweep(part, a.end)), lambda x: F.struct(x.end.alias("end"), F.concat(a.out, F.array(x.out)).alias("out"))), 1)

        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<array<struct<kind:string,s:int,e:int>>>)").alias("out")), add, lambda a: a.out))

    return F.element_at(F.transform(F.array(picked), lambda many: F.when(F.size(many) == 0, F.expr(none)).otherwise(all_of(many))), 1)


def _listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def _all(model: dict) -> Column:
    more = added(model)
    return F.concat(*(F.sort_array(F.filter(F.concat(F.col("_kv_base"), F.col("_kv_more")), _of(k))) for k in KINDS)), more


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, and ``spans``, all spans."""
    df = materialise(spans(docs.select("doc_id", "text")).drop("text"))
    every, more = _all(learn(df, precision))
    df = df.withColumn("_kv_more", more)
    count = lambda k: F.size(F.filter("_kv_base", _of(k))).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *(count(k) for k in KINDS), F.sha2(_listed(F.col("_kv_base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """The rows of ``docs`` with each span (overlapping ones together) replaced by its first kind in brackets.

    Rows are written with their spans, so that candidates are looked for once."""
    df = materialise(spans(docs))
    model = learn(df, precision)
    df = df.withColumn("_kv_more", _all(model)[1])
    order = F.sort_array(F.transform(F.concat("_kv_base", "_kv_more"), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"))))
    df = df.withColumn("_kv_all", order)
    text = F.col("text")
    parts = F.aggregate(
        "_kv_all",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(F.greatest(a.at, x.e).alias("at"), F.when(x.s < a.at, a.out).otherwise(F.concat(a.out, F.substring(text, a.at + 1, x.s - a.at), F.lit("["), F.upper(x.kind), F.lit("]"))).alias("out")),
        lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))),
    )
    df = df.withColumn("text", F.when(F.size("_kv_all") > 0, parts).otherwise(text))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))
