"""Text normalization as column expressions.

Folding lower-cases first, then decomposes and drops marks. Characters that fold to one character or to
none are one ``translate`` whose table comes from the Unicode data; a few letters fold to two. Texts that hold
others (ligatures, fractions, composed Indic letters, Hangul) are folded character by character through a map, also in the plan.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters without a decomposition, and characters that are dropped.
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "þ": "th", "ð": "d"}
DROPPED = "​‌‍⁠﻿"
#: Address components that mean "none", and digits read as letters.
NOTHING = ["", "n/a", "na", "nan", "null", "none", "nil", "-", "--"]
LEET = ("0123456789", "olzeasgtbg")
INDIC = "ऀ-෿"
#: The endings that make a word without spaces a domain, and those that are cut off it.
_DOMAIN = r"^[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)*\.(?:com|net|org|in|fr|co|biz|info|io|us)$"
_SUFFIX = r"\.(?:co\.in|co\.uk|com|net|org|in|fr|co|biz|info|io|us)$"


def _fold_char(c: str) -> str:
    out = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ" and x not in DROPPED)
    return "".join(SPECIAL.get(x, x) for x in out)


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to another one, then those that fold to none; what the first become; those that fold to several.

    Lower-casing comes first, so capitals that have a small letter are left out. Hangul syllables are two or three letters each by rule.
    """
    to_one, to_none, to_many = [], [], {}
    for k in [*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        c = chr(k)
        if 0xAC00 <= k <= 0xD7A3 or c.lower() != c:
            continue
        f = _fold_char(c)
        if len(f) > 1 and c not in SPECIAL:
            to_many[c] = f
        elif not f:
            to_none.append(c)
        elif len(f) == 1 and f != c:
            to_one.append((c, f))
    return "".join(a for a, _ in to_one) + "".join(to_none), "".join(b for _, b in to_one), to_many


def _ranges(chars: list[str]) -> str:
    """A character class of the given characters, as Java writes it."""
    out, codes = [], sorted(map(ord, chars))
    for k in codes:
        if out and out[-1][1] == k - 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def _hangul(c: Column) -> Column:
    """A syllable as its two or three letters."""
    k = F.ascii(c) - 0xAC00
    one = lambda base, n: F.decode(F.unhex(F.lpad(F.hex(base + n), 4, "0")), "UTF-16BE")
    return F.when(k.between(0, 11171), F.concat(one(0x1100, (k / 588).cast("int")), one(0x1161, (k % 588 / 28).cast("int")), F.when(k % 28 > 0, one(0x11A7, k % 28)).otherwise("")))


def fold(x: Column) -> Column:
    single, to, many = _tables()
    low = F.lower(x)
    letters = {a: b for a, b in SPECIAL.items() if len(b) > 1}

    def plain(t: Column) -> Column:
        out = F.translate(t, single, to)
        for a, b in letters.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    # the several characters of a rare one, by its place among the rare ones; both lists are one literal each
    several = F.split(F.lit("\x1f".join(many.values())), "\x1f")
    found = lambda c: F.get(several, F.instr(F.lit("".join(many)), c) - 1)
    rare = _ranges([*many])[:-1] + "\\x{AC00}-\\x{D7A3}]"
    # cut around the rare ones: what lies between them stays in one piece
    each = F.transform(F.split(low, f"(?={rare})|(?<={rare})"), lambda c: F.when((F.length(c) == 1) & c.rlike(rare), F.coalesce(_hangul(c), found(c))).otherwise(c))
    return F.when(~low.rlike(r"[^\x00-\x7F]"), low).when(low.rlike(rare), plain(F.array_join(each, ""))).otherwise(plain(low))


@F.pandas_udf(T.StringType())
def fold_exact(x: pd.Series) -> pd.Series:
    return x.map(lambda s: "".join(map(_fold_char, s.lower())), na_action="ignore")


def tokens(folded: Column) -> Column:
    """'&' reads as "and"; all but a-z, 0-9 and Indic letters separates. Blank text has none."""
    text = F.replace(folded, F.lit("&"), F.lit(" and "))
    return F.filter(F.split(F.regexp_replace(text, rf"[^0-9a-z{INDIC}]+", " "), " "), lambda t: t != "")


class _Separating(dict):
    """A table for ``str.translate`` in which all that it does not name separates words."""

    def __missing__(self, k: int) -> str:
        self[k] = " "
        return " "


@lru_cache(maxsize=1)
def _word_table() -> dict[int, str]:
    """What ``fold`` and then ``tokens`` make of a character: letters, digits and spaces.

    Lower-casing is by character here. It looks around only for the last sigma of a word, and Greek letters separate words.
    """
    single, to, many = _tables()
    kept = {chr(k): chr(k) for k in [*range(48, 58), *range(97, 123), *range(ord(INDIC[0]), ord(INDIC[2]) + 1)]}
    folded = kept | {c: to[i : i + 1] for i, c in enumerate(single)} | many | {a: b for a, b in SPECIAL.items() if len(b) > 1}
    clean = lambda f: "".join(" and " if x == "&" else kept.get(x, " ") for x in f)
    capitals = {c: "".join(folded.get(x, x) for x in c.lower()) for c in map(chr, range(0x110000)) if c.lower() != c}
    return _Separating({ord(c): clean(f) for c, f in (folded | capitals).items()})


_ZEROS = re.compile(r"(?<![^ ])0+(?=[0-9]+(?![^ ]))")


def split_text(text: str, first: int) -> tuple[str, str]:
    """The first words of a text, and all others without leading zeros of numbers."""
    words = text.replace("&", " and ").translate(_word_table()).split()
    rest = " ".join(words[first:])
    return " ".join(words[:first]), _ZEROS.sub("", rest) if rest[:1] == "0" or " 0" in rest else rest


def head_and_rest(x: Column, first: int) -> Column:
    """struct(head, rest): the first words of ``tokens(fold(x))``, and all others ``without_zeros``, both joined. Null for null text.

    For long texts: one pass over the characters and one crossing, where the expressions make each word an object several times.
    """

    @F.arrow_udf("head string, rest string")
    def run(texts: pa.Array) -> pa.Array:
        got = [None if t is None else split_text(t, first) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g and g[k] for g in got], pa.string()) for k in (0, 1)], ["head", "rest"])

    return run(x)


def without_runs(xs: Column) -> Column:
    """Drops a token equal to the one before it."""
    return F.filter(xs, lambda t, i: (i == 0) | (t != F.get(xs, i - 1)))


def norm_name(x: Column) -> Column:
    """struct(name, is_domain)."""
    plain = fold(F.trim(x))
    is_domain = ~plain.contains(" ") & plain.rlike(_DOMAIN)
    stem = F.translate(F.regexp_replace(plain, _SUFFIX, ""), "-.", "")
    name = F.when(is_domain, stem).otherwise(F.array_join(without_runs(tokens(plain)), " "))
    return F.struct(name.alias("name"), F.coalesce(is_domain, F.lit(False)).alias("is_domain"))


def without_zeros(t: Column) -> Column:
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)


def norm_addr(x: Column) -> Column:
    parts = F.filter(F.split(fold(x), ","), lambda c: ~F.trim(c).isin(NOTHING))
    words = F.flatten(F.transform(parts, tokens))
    return F.array_join(F.transform(words, without_zeros), " ")


def squash(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def leet(t: Column) -> Column:
    """Digits inside words read as letters; plain numbers and ordinals stay."""
    word = t.rlike("[0-9]") & t.rlike("[a-z]") & ~t.rlike("^[0-9]+(st|nd|rd|th)$")
    return F.when(word, F.translate(t, *LEET)).otherwise(t)


def is_native(x: Column) -> Column:
    return x.rlike(f"[{INDIC}]")


def split_words(x: Column) -> Column:
    """The words of normalized text; none for blank text."""
    return F.filter(F.split(x, " "), lambda t: t != "")
