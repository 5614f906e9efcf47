"""Text functions as column expressions; NFKC and difflib are the only Python functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as lx

WS = r"[\p{IsWhite_Space}\x1c-\x1f]"


def any_of(words) -> str:
    """An alternation of literal words, longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(x, WS, "")


@F.pandas_udf(T.StringType())
def nfkc(x):
    import unicodedata

    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def nfkc_words(x):
    """NFKC, stripped, of arrays of arrays of strings; null stays null."""
    import unicodedata

    return x.map(lambda a: None if a is None else [[None if v is None else unicodedata.normalize("NFKC", v).strip() for v in b] for b in a])


def word_text(x: Column) -> Column:
    return strip(nfkc(x))


def _quotes(quotes) -> str:
    return "[" + "".join(re.escape(q) for q in quotes) + "]*$"


def ends_with_any(x: Column, words, quotes=lx.CLOSING_QUOTES) -> Column:
    """Whether the text, without white space and closing quotes at its end, ends with one of the words."""
    trimmed = F.regexp_replace(compact(x), _quotes(quotes), "")
    return trimmed.rlike(any_of(words) + "$")


def starts_with_any(x: Column, words) -> Column:
    return compact(x).rlike("^" + any_of(words))


def has_kanji(x: Column) -> Column:
    return x.rlike(r"[\x{3400}-\x{9fff}]")


def has_japanese(x: Column) -> Column:
    return x.rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]")


def hiragana(x: Column) -> Column:
    """Katakana of U+30A1-30F6 as hiragana; a lone * is empty."""
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    hira = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
    y = strip(x)
    return F.when(y == "*", F.lit("")).otherwise(F.translate(y, kata, hira))


def safety_core(x: Column) -> Column:
    """For NFKC text: lower case without white space and punctuation."""
    return F.lower(F.regexp_replace(x, r"[\p{P}\p{IsWhite_Space}\x1c-\x1f]", ""))


def boundary_overlap(left: Column, right: Column) -> Column:
    """The longest n >= 2 such that compact left ends with the first n characters of compact right; else 0."""

    def longest(s):
        limit = F.least(F.length(s["a"]), F.length(s["b"]))
        tries = F.when(limit >= 2, F.sequence(limit, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(tries, lambda n: F.endswith(s["a"], F.substring(s["b"], F.lit(1), n))), F.lit(0))

    # an array of one holds the compact texts, so that they are not made again for each length
    once = F.array(F.struct(compact(left).alias("a"), compact(right).alias("b")))
    return F.coalesce(F.get(F.transform(once, longest), F.lit(0)), F.lit(0))


def readable(x: Column, markers=lx.DISCOURSE_MARKERS, exclusions=lx.NON_DISCOURSE_PREFIXES, comma=lx.COMMA, period=lx.PERIOD) -> Column:
    """Subtitle text: full-width marks, single spaces, none between Japanese characters, a comma after an opening marker."""
    y = strip(x)
    for a, b in ((",", comma), ("，", comma), (".", period), ("．", period)):
        y = F.replace(y, F.lit(a), F.lit(b))
    y = F.regexp_replace(y, f"{WS}+", " ")
    y = F.regexp_replace(y, r"(?<=[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]) (?=[\x{3040}-\x{30ff}\x{3400}-\x{9fff}])", "")
    opened = y
    for m in sorted(markers, key=len):
        rest = F.substring(y, F.lit(len(m) + 1), F.length(y))
        fixed = F.when((rest == "") | rest.startswith(comma), y).otherwise(F.concat(F.lit(m + comma), rest))
        opened = F.when(y.startswith(m), fixed).otherwise(opened)
    y = F.when(y.rlike("^" + any_of(exclusions)), y).otherwise(opened) if exclusions else opened
    for mark in (period, comma, "？", "！"):
        y = F.regexp_replace(y, f"{re.escape(mark)}+", mark)
    return y


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, half-even; null for negative times."""
    ms = F.rint(seconds * 1000).cast("long")
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.when(seconds >= 0, text)


def srt_block(index: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n\n"))


def clean_output(x: Column, markers=("PREV:", "NEXT:", "CURRENT:", "出力:")) -> Column:
    y = strip(x)
    for m in markers:
        y = F.replace(y, F.lit(m), F.lit(""))
    return strip(F.regexp_replace(y, f"{WS}+", " "))


def path_fragment(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(x), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
