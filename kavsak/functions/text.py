"""Text normalization as Column expressions: Column -> Column, all inside one projection."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Turkish letters and their ASCII forms; the combining dot that lower-casing leaves behind.
TR_LETTERS, ASCII_LETTERS, DOT = "çğışöüÇĞİÖŞÜ", "cgisoucgiosu", "\u0307"


def tr_safe_lower(x: Column) -> Column:
    """Lower case in which I and İ both give i."""
    return F.replace(F.lower(F.replace(x, F.lit("İ"), F.lit("I"))), F.lit(DOT), F.lit(""))


def tr_lower(x: Column) -> Column:
    """Lower case in which I gives ı and İ gives i."""
    return F.replace(F.lower(F.translate(x, "Iİ", "ıi")), F.lit(DOT), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; Spark SQL has no function for it."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def unmojibake(x: Column) -> Column:
    """UTF-8 that was read as latin-1 is read again; any text for which that fails stays as it is."""
    # characters beyond latin-1 have no such bytes; encoding them fails, so they are replaced where the result isn't used
    raw = F.encode(F.regexp_replace(x, "[^\\x00-\\xff]", "?"), "ISO-8859-1").cast("string")
    return F.when(x.rlike("[ÃÄÅ]") & ~x.rlike("[^\\x00-\\xff]") & F.is_valid_utf8(raw), raw).otherwise(x)


def fold(x: Column) -> Column:
    return F.translate(x, TR_LETTERS, ASCII_LETTERS)


def collapse(x: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\w\s]", " ")


def java_pattern(pattern: str) -> str | None:
    """A Python pattern for Java, or None if either rejects it."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    context = SparkContext._active_spark_context
    if context:
        try:
            context._jvm.java.util.regex.Pattern.compile(f"(?U){pattern}")
        except Exception:  # noqa: BLE001  what the JVM throws comes in several wrappings
            return None
    return pattern


def substitute(x: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Rules in order; a pattern that Python or Java rejects is skipped, \\1 is turned into $1."""
    for pattern, to in rules:
        found = java_pattern(pattern)
        if found is not None:
            x = F.regexp_replace(x, f"(?U){found}", re.sub(r"\\(\d)", r"$\1", to))
    return x


def literals(x: Column, pairs: Mapping[str, str]) -> Column:
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def abbreviations(x: Column, pairs: Mapping[str, str]) -> Column:
    """Expand whole words; a key is taken literally."""
    for a, b in pairs.items():
        x = F.regexp_replace(x, rf"(?U)\b{re.escape(a)}\b", b.replace("$", r"\$"))
    return x


def without_words(x: Column, words: Sequence[str]) -> Column:
    """Drop words of the list; what stays is joined by blanks."""
    parts = F.filter(F.split(x, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*words))
    return F.array_join(parts, " ") if words else x


def null_tokens(x: Column) -> Column:
    """NULL and the words nan and none become empty."""
    return F.when(x.isNull() | F.lower(F.trim(x)).isin("nan", "none"), F.lit("")).otherwise(x)


def hygiene(df: DataFrame) -> DataFrame:
    """Every string column on one line, without blanks at its ends."""
    return df.select(*(one_line(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: a generator, which the optimizer doesn't copy into what uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def one_line(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\r?\n", " "), r"(?U)^\s+|\s+$", "")


@dataclass(frozen=True)
class NormalizeConfig:
    """Switches and rule lists of the configurable normalizer."""

    fix_mojibake: bool = False
    lowercase: bool = True
    fold_diacritics: bool = False
    regex: Sequence[tuple[str, str]] = ()
    replace: Mapping[str, str] = field(default_factory=dict)
    abbreviations: Mapping[str, str] = field(default_factory=dict)
    stopwords: Sequence[str] = ()
    strip_punctuation: bool = False
    strip_extra_spaces: bool = True


def normalize(x: Column, config: NormalizeConfig = NormalizeConfig()) -> Column:
    """The configured steps in their fixed order; NULL counts as empty."""
    x = F.coalesce(x, F.lit(""))
    if config.fix_mojibake:
        x = unmojibake(x)
    if config.lowercase:
        x = tr_safe_lower(x)
    if config.fold_diacritics:
        x = fold(x)
    x = abbreviations(literals(substitute(x, config.regex), config.replace), config.abbreviations)
    if config.stopwords:
        x = without_words(x, config.stopwords)
    if config.strip_punctuation:
        x = strip_punctuation(x)
    return collapse(x) if config.strip_extra_spaces else x


#: Words that both token normalizers replace; a dotted word is looked up as it is, then without its dots.
WORDS = {
    "mah": "mahalle", "mah.": "mahalle", "mahallesi": "mahalle", "cad": "caddesi", "cad.": "caddesi", "cadd.": "caddesi", "caddesi": "caddesi",
    "sk": "sokak", "sk.": "sokak", "sok": "sokak", "sok.": "sokak", "blv": "bulvarı", "blv.": "bulvarı", "bulv.": "bulvarı", "bulv": "bulvarı", "bulvari": "bulvarı", "bulvar": "bulvarı",
    "no": "no", "no.": "no", "kat.": "kat", "daire": "daire", "dr.": "doktor",
}
#: What only the first of them knows, and what only the inline normalizer knows.
TOKEN_WORDS = {"mh": "mahalle", "cd": "caddesi"}
INLINE_WORDS = {"mh.": "mahalle", "cd.": "caddesi", "sokağı": "sokak", "sokaği": "sokak"}


def expand(tokens: Column, words: Mapping[str, str]) -> Column:
    """Each token's replacement, if it or its form without outer dots has one."""
    known = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.try_element_at(known, F.btrim(t, F.lit("."))), t))


def _plain(x: Column) -> Column:
    return F.regexp_replace(tr_lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s/.,-]", " ")


def address_tokens(x: Column) -> Column:
    """Tokens of letters, digits, dots, slashes and dashes, abbreviations expanded."""
    return expand(F.regexp_extract_all(collapse(_plain(x)), F.lit("[A-Za-zÇĞİÖŞÜçğıöşü0-9./-]+"), F.lit(0)), WORDS | TOKEN_WORDS)


def normalize_inline(x: Column) -> Column:
    """The one-step normalizer: composed, lower case, runs of marks give their first, digits apart by a blank are joined."""
    x = collapse(F.regexp_replace(_plain(nfkc(x)), "([.,/-])[.,/-]+", "$1"))
    x = F.regexp_replace(x, r"(?<=\d)\s+(?=\d)", "")
    return F.array_join(expand(F.split(x, " "), WORDS | INLINE_WORDS), " ")


def array_text(x: Column) -> Column:
    """Tokens of ``address_tokens``, joined by blanks."""
    return F.array_join(address_tokens(x), " ")
