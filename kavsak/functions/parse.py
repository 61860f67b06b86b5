"""Address parsing as Column expressions: a text becomes a struct of components and a confidence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Component names in their order, and word lists that results depend on.
PARTS = ("mahalle", "cadde", "sokak", "no", "daire", "kat", "bina_adi", "mevkii", "il", "ilce")
PROVINCES_A = ("istanbul", "ankara", "izmir", "bursa", "antalya", "muğla", "aydın", "tekirdağ", "kocaeli", "konya", "adana", "mersin", "samsun", "eskişehir", "trabzon", "kayseri", "gaziantep")
DISTRICTS_A = ("fethiye", "çeşme", "bodrum", "kartal", "kadıköy", "üsküdar", "ataşehir", "bornova", "konak", "mamak", "keçiören", "tepebaşı", "odunpazarı", "tarsus", "tekkeköy")
PROVINCES_C = (*PROVINCES_A, "balıkesir", "manisa", "şanlıurfa", "diyarbakır", "hatay", "k.maraş", "kahramanmaraş", "denizli", "sakarya", "tekirdag")
DISTRICTS_C = (*DISTRICTS_A, "buca", "karabağlar", "karşıyaka", "menemen", "bayrakli", "bayraklı", "çamlıyayla", "muratpaşa", "kepez", "seyhan", "yüreğir", "çankaya", "yenimahalle")
TRIGGERS_A = ("apartman", "residence", "rezidans", "blok", "işhanı", "iş hanı", "plaza", "hotel", "otel")
#: Fixed value: words that end a building's name for the postprocessor.
TRIGGERS_P = ("apartman", "residence", "rezidans", "işhanı", "iş", "hanı", "otel", "hotel", "site", "blok", "plaza", "tower")
STOPS_A = ("mahalle", "cadde", "sokak", "bulvar", "no", "daire", "kat", "mevkii", "apartman", "hotel", "otel", "plaza", "blok", "işhanı", "iş hanı", "$")
STOPS_C = (*STOPS_A[:-1], "bina", "site", "sitesi", "residence", "rezidans", "$")
CUTS = ("no", "daire", "kat", "mevkii", "il", "ilçe", "ilce", "mahalle", "cadde", "sokak", "bulvar")
LETTERS = "a-zğüşiöç"
#: What the two cleaners expand, in order. The missing closing boundaries after no, daire, k and kat are
#: kept on purpose: results depend on them (kadıköy becomes "kat adıköy"); ``strict=False`` closes them.
ABBREVIATIONS_A = (
    (r"\bmah\.?\b", "mahalle"), (r"\bmahallesi\b", "mahalle"), (r"\bmh\.?\b", "mahalle"), (r"\bcad\.?\b", "cadde"), (r"\bcaddesi\b", "cadde"), (r"\bcd\.?\b", "cadde"),
    (r"\bsok\.?\b", "sokak"), (r"\bsokağı\b", "sokak"), (r"\bsk\.?\b", "sokak"), (r"\bbulv?\.?\b", "bulvar"), (r"\bbulvarı\b", "bulvar"), (r"\bno:?", "no "), (r"\bkapı no:?", "no "),
    (r"\bd[.:]\b", "daire "), (r"\bdaire:?", "daire "), (r"\bk:?", "kat "), (r"\bkat:?", "kat "), (r"\bapt\.?\b", "apartman"), (r"\bap\b", "apartman"), (r"\bmevkii\b", "mevkii"),
)
ABBREVIATIONS_C = (
    (r"\bmahallesi\b", "mahalle"), (r"\bmah\b", "mahalle"), (r"\bmh\b", "mahalle"), (r"\bmhl\b", "mahalle"), (r"\bmah.\b", "mahalle"), (r"\bmh.\b", "mahalle"), (r"\bmahalle\b", "mahalle"),
    (r"\bcaddesi\b", "cadde"), (r"\bcad\b", "cadde"), (r"\bcd\b", "cadde"), (r"\bsokağı\b", "sokak"), (r"\bsokagi\b", "sokak"), (r"\bsok\b", "sokak"), (r"\bsk\b", "sokak"),
    (r"\bbulv?\b", "bulvar"), (r"\bbulvarı\b", "bulvar"), (r"\bno\.?\b", "no"), (r"\bnumara\b", "no"), (r"\bkapı\s*no\b", "no"), (r"\bd[.]\b", "daire"), (r"\bd\b(?=\s*\d)", "daire"),
    (r"\bdaire\b", "daire"), (r"\bk\b(?=\s*\d)", "kat"), (r"\bapt\b", "apartman"), (r"\bap\b", "apartman"), (r"\bblv\b", "bulvar"),
)
SEPARATORS = ((r"(?<=\D)[.,](?=\D)", " "), (r"(?<=\D)[.,](?=\d)", " "), (r"(?<=\d)[,](?=\D)", " "))


def clean_a(x: Column, strict: bool = True) -> Column:
    """The first cleaner: punctuation that separates nothing goes, abbreviations are expanded."""
    rules = ABBREVIATIONS_A if strict else tuple((rf"{p}(?![^\W\d_])" if p.endswith(":?") else p, r) for p, r in ABBREVIATIONS_A)
    x = T.substitute(T.tr_lower(T.nfkc(F.coalesce(x, F.lit("")))), (*SEPARATORS, (r"[;:|]+", " "), *rules))
    return T.collapse(T.substitute(x, ((r"\bd\s+(?=\d)", "daire "), (r"\bno\s*[:\-]?\s*(\d+)", r"no \1"), (r"(\d+)\.(sokak|cadde|mahalle)\b", r"\1 \2"), (r"(?<!\d)/(?!\d)", " / "))))


def clean_c(x: Column) -> Column:
    """The file cleaner: as the first one, but only letters, digits, blanks and ./- stay."""
    x = F.regexp_replace(T.tr_lower(T.nfkc(F.coalesce(x, F.lit("")))), r"\r?\n", " ")
    x = T.substitute(x, (*SEPARATORS, (r"[(){}\[\]!?]+", " "), (r"\s*[:;|]\s*", " ")))
    x = F.regexp_replace(x, r"(?iuU)[^0-9a-zçğıöşü\s./\-]", " ")
    x = T.substitute(x, ((r"(\d+)\.(sokak|cadde|mahalle)\b", r"\1 \2"), (r"(?<!\d)/(?!\d)", " / "), *ABBREVIATIONS_C))
    return T.collapse(T.substitute(x, ((r"\bno\s*([0-9]+[a-z]?(?:/[0-9a-z]+)?)\b", r"no \1"), (r"\bkat\s*([0-9]+[a-z]?)\b", r"kat \1"), (r"\bdaire\s*([0-9]+[a-z]?)\b", r"daire \1"))))


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(x, f"(?U){pattern}", group), F.lit(""))


def house(x: Column) -> tuple[Column, Column]:
    """House number and, if it reads N/M with digits on both sides, the flat M."""
    no = extract(x, r"\bno\s*([0-9]+[a-z]?(?:/[0-9a-z]+)?)\b")
    both = no.rlike(r"^[0-9]+/[0-9]+$")
    return F.when(both, F.split_part(no, F.lit("/"), F.lit(1))).otherwise(no), F.when(both, F.split_part(no, F.lit("/"), F.lit(2)))


def numbered(x: Column, word: str) -> Column:
    """The token after ``word``, if the first one there is a number with at most one letter."""
    found = extract(x, rf"\b{word}\s*([0-9a-z]+)\b")
    return F.when(found.rlike(r"^[0-9]+[a-z]?$"), found)


def name_after(x: Column, anchor: str, stops: Sequence[str]) -> Column:
    """The shortest name that follows the anchor and has a stop word after it."""
    return F.nullif(T.collapse(F.regexp_extract(x, rf"(?U){anchor}\s+([{LETTERS}0-9 \-]+?)\s+(?={'|'.join(stops)})", 1)), F.lit(""))


def numbered_street(x: Column) -> Column:
    return extract(x, r"\b(\d+)\s+sokak\b")


def locality(x: Column) -> Column:
    return extract(x, rf"\b([{LETTERS}\-]+)\s+mevkii\b")


def building(x: Column, triggers: Sequence[str]) -> Column:
    """The first trigger word with up to two words before it."""
    found = rf"(?U)\b({'|'.join(triggers)})\b"
    at = F.regexp_instr(x, F.lit(found))
    left = F.regexp_extract_all(F.substring(x, F.lit(1), at - 1), F.lit(rf"[{LETTERS}\-]+"), F.lit(0))
    name = F.array_join(F.concat(F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), F.lit(2)), F.array(F.regexp_extract(x, found, 1))), " ")
    name = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"^\bno\b\s*\d+[a-z]?/?\d*\s*", "")), r"^\d+[a-z]?\s*", ""))
    return F.when(at > 0, F.nullif(name, F.lit("")))


def hinted(x: Column, words: Sequence[str]) -> Column:
    """A word of the list, from the last piece between slashes that has one; the list's order decides within a piece."""
    known = F.array(*(F.lit(w) for w in words))
    hits = F.transform(F.reverse(F.split(x, "/")), lambda p: F.get(F.array_intersect(known, F.split(p, r"(?U)\s+")), F.lit(0)))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))


def present(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in xs))


def confidence(parts: dict[str, Column], each: float) -> Column:
    """``each`` for a part found, more for a number and for any of the street parts; between 0 and 1."""
    street = F.coalesce(parts["mahalle"], parts["cadde"], parts["sokak"]).isNotNull().cast("int")
    more = 0.2 if each == 0.2 else 0.15
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), each * present(*(parts[k] for k in PARTS)) + more * present(parts["no"]) + 0.2 * street)), 2)


def _parts(x: Column, provinces, districts, stops, triggers, each: float) -> Column:
    no, flat = house(x)
    name = lambda anchor: F.nullif(F.trim(F.regexp_replace(name_after(x, anchor, stops), r"^(no\s*\d+[a-z]?(?:/\d+)?)\b", "")), F.lit("")) if each != 0.2 else name_after(x, anchor, stops)
    parts = {"mahalle": name("mahalle"), "cadde": name("cadde"), "sokak": F.coalesce(numbered_street(x), name("sokak")), "no": no, "daire": F.coalesce(flat, numbered(x, "daire")), "kat": numbered(x, "kat"), "bina_adi": building(x, triggers), "mevkii": locality(x), "il": hinted(x, provinces), "ilce": hinted(x, districts)}
    return F.struct(*(v.alias(k) for k, v in parts.items()), confidence(parts, each).alias("confidence"))


def parse_a(cleaned: Column) -> Column:
    """Components of a text that ``clean_a`` has cleaned."""
    return _parts(cleaned, PROVINCES_A, DISTRICTS_A, STOPS_A, TRIGGERS_A, 0.2)


def parse_c(cleaned: Column) -> Column:
    """Components of a text that ``clean_c`` has cleaned."""
    return _parts(cleaned, PROVINCES_C, DISTRICTS_C, STOPS_C, (*TRIGGERS_A, "site", "sitesi", "bina"), 0.15)


def window(tokens: Column, label: str, numbers: bool) -> tuple[Column, Column]:
    """Up to three tokens before and after the label's first place, as far as the next cut word (or, unless ``numbers``, digit)."""
    at = F.array_position(tokens, label).cast("int")
    cut = lambda w: w.isin(*CUTS) | (F.lit(not numbers) & w.rlike("[0-9]"))

    def run(words: Column) -> Column:
        stop = F.filter(F.transform(words, lambda w, i: F.when(cut(w), i)), lambda i: i.isNotNull())
        return F.slice(words, F.lit(1), F.coalesce(F.get(stop, F.lit(0)), F.size(words)))

    before = run(F.slice(F.reverse(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0)))), F.lit(1), F.lit(3)))
    after = run(F.slice(tokens, at + 1, F.lit(3)))
    name = lambda xs: F.when(at > 0, F.nullif(F.array_join(xs, " "), F.lit("")))
    return name(F.reverse(before)), name(after)


def tail_city(tokens: Column, provinces: Sequence[str]) -> tuple[Column, Column]:
    """Province and district from the last adjacent pair of plain words, among eight, of which the second alone is a province."""
    tail = F.slice(tokens, -F.least(F.size(tokens), F.lit(8)), F.lit(8))
    known = lambda w: w.isin(*provinces)
    plain = lambda w: w.rlike("^[a-zçğıöşü]+$")
    pairs = F.transform(tail, lambda w, i: F.when((i > 0) & plain(w) & known(w) & plain(F.get(tail, i - 1)) & ~known(F.get(tail, i - 1)), F.struct(w.alias("il"), F.get(tail, i - 1).alias("ilce"))))
    last = F.get(F.reverse(F.filter(pairs, lambda p: p.isNotNull())), F.lit(0))
    return last.getField("il"), last.getField("ilce")


def repaired_building(tokens: Column, now: Column) -> Column:
    """The first building word with the plain words among the two before it, if ``now`` is missing, bare or a number."""
    at = F.array_min(F.transform(tokens, lambda w, i: F.when(w.isin(*TRIGGERS_P), i)))
    word = F.get(tokens, at)
    near = F.slice(tokens, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))
    name = F.array_join(F.concat(F.filter(near, lambda w: w.rlike(rf"^[{LETTERS}-]+$") & ~w.isin("no", "daire", "kat", "mevkii", "il", "ilçe", "ilce")), F.array(word)), " ")
    return F.when(at.isNotNull() & (now.isNull() | (now == word) | now.rlike("^(no|[0-9])")), name).otherwise(now)


def repair(cleaned: Column, parts: Column, provinces: Sequence[str]) -> Column:
    """The postprocessor: numbers split, names taken from before their label, province from the tail, a new confidence."""
    tokens = F.split(cleaned, " ")
    p = {k: parts.getField(k) for k in PARTS}
    number = lambda x: F.when(x.rlike(r"^[0-9]+[a-z]?$"), x)
    p["daire"], p["kat"] = number(p["daire"]), number(p["kat"])
    for k in ("mahalle", "cadde"):
        before, after = window(tokens, k, False)
        p[k] = F.coalesce(before, after, p[k])
    before, after = window(tokens, "sokak", True)
    old = F.when(F.startswith(p["sokak"], F.lit("no")), numbered_street(cleaned)).otherwise(p["sokak"])
    p["sokak"] = F.when(before.rlike("^[0-9/]*[0-9][0-9/]*$"), before).when(after.isNotNull() & ~F.split_part(after, F.lit(" "), F.lit(1)).rlike("[0-9]"), after).otherwise(old)
    p["bina_adi"] = repaired_building(tokens, p["bina_adi"])
    p["mevkii"] = F.coalesce(locality(cleaned), p["mevkii"])
    il, ilce = tail_city(tokens, provinces)
    p["il"], p["ilce"] = F.coalesce(il, p["il"]), F.when(il.isNotNull(), ilce).otherwise(p["ilce"])
    for k in ("mahalle", "cadde", "sokak"):
        p[k] = F.nullif(F.trim(F.regexp_replace(p[k], r"\bno\b.*$", "")), F.lit(""))
    score = 0.22 * present(*(p[k] for k in ("mahalle", "cadde", "sokak", "no"))) + 0.06 * present(p["daire"], p["kat"], F.coalesce(p["bina_adi"], p["mevkii"]), p["il"])
    return F.struct(*(v.alias(k) for k, v in p.items()), F.nullif(F.round(F.least(F.lit(1.0), score), 2), F.lit(0.0)).alias("confidence"))


#: Fixed value: the order and names of parts in texts.
SHOWN = (("il", "il"), ("ilçe", "ilce"), ("mahalle", "mahalle"), ("cadde", "cadde"), ("sokak", "sokak"), ("no", "no"), ("daire", "daire"), ("kat", "kat"), ("bina_adı", "bina_adi"), ("mevkii", "mevkii"))
SIGNED = ("mahalle", "cadde", "sokak", "no", "daire", "kat", "bina_adi", "mevkii", "il", "ilce")


def parts_text(parts: Column) -> Column:
    """name:value of the parts there are, joined by bars."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{n}:"), parts.getField(k)) for n, k in SHOWN))


def parts_json(parts: Column) -> Column:
    """The parts there are as a JSON object."""
    return F.to_json(F.struct(*(parts.getField(k).alias(n) for n, k in SHOWN)))


def signature(cleaned: Column, parts: Column) -> Column:
    """The text that retrieval compares."""
    return F.concat(cleaned, F.lit(" | "), F.concat_ws(" ", *(F.concat(F.lit(f"{dict((b, a) for a, b in SHOWN)[k]}:"), parts.getField(k)) for k in SIGNED)))


def weak_labels(tokens: Column, neighbourhoods: Sequence[str], provinces: Sequence[str], districts: Sequence[str]) -> Column:
    """A tag for each token: neighbourhoods win, then districts, then provinces."""
    return F.transform(tokens, lambda t: F.when(t.isin(*neighbourhoods), "B-MAHALLE").when(t.isin(*districts), "B-ILCE").when(t.isin(*provinces), "B-IL").otherwise("O"))


def by_patterns(x: Column, patterns: Mapping[str, str]) -> Column:
    """A struct of the first group (or the match, without a group) of each configured pattern, NULL where it isn't found."""
    first = lambda p: extract(x, p, 1 if re.compile(p).groups else 0)
    return F.struct(*(first(p).alias(name) for name, p in patterns.items()))


def side_text(parts: Column) -> Column:
    """All ten parts, joined by blanks after a leading one."""
    return F.concat(F.lit(" "), F.concat_ws(" ", *(parts.getField(k) for k in PARTS)))


def prediction(cleaned: Column, parts: Column, mode: str) -> Column:
    """What is predicted from: the cleaned text, or its parts as JSON or as text."""
    forms = {"normalized": cleaned, "parts_json": parts_json(parts), "parts_string": parts_text(parts)}
    if mode not in forms:
        raise ValueError(f"mode must be one of {', '.join(forms)}")
    return forms[mode]
