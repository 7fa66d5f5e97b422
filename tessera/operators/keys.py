"""Blocking keys. Each family is an array expression, so one explode yields all of a record's keys.

Families whose keys need the rarest words of a record join a vocabulary first (``rarest``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


#: A vocabulary is broadcast up to so many bytes, counted; beyond, its OFTEN most frequent words are.
BROADCAST_BYTES = 16 << 20
OFTEN = 100_000


@dataclass(frozen=True)
class KeyConfig:
    """Caps are the most reference records that a key may have."""

    caps: dict = field(default_factory=lambda: {"n": 40, "a": 40, "b": 150, "q": 150, "p": 100, "h": 100, "x": 150, "c": 0})
    prefix: int = 8
    min_squashed: int = 6
    pair_words: int = 5
    pair_words_reference: int = 7


@dataclass(frozen=True)
class CorruptionConfig:
    caps: dict = field(default_factory=lambda: {"nb": 200, "ag": 200, "hn": 200, "cx": 200, "sw": 200, "ty": 60})
    deletions: int = 2
    stop_share: float = 0.004
    words: int = 3
    words_reference: int = 4
    names: int = 2


def _tag(tag: str, xs: Column) -> Column:
    return F.transform(xs, lambda x: F.concat(F.lit(tag + ":"), x))


def _pairs(xs: Column, ys: Column, sep: str = "_") -> Column:
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.concat(x, F.lit(sep), y))))


def has_digit(t: Column) -> Column:
    """A number, or a word with a digit of any script; neither is a plain word."""
    return t.rlike(r"(?U)\d")


def token_keys(tag: str, words: Column) -> Column:
    return _tag(tag, F.array_distinct(words))


def bigram_keys(words: Column) -> Column:
    n = F.size(words)
    both = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return _tag("b", F.array_distinct(both))


def squash_keys(name_sq: Column, cfg: KeyConfig) -> Column:
    return F.when(F.length(name_sq) >= cfg.min_squashed, F.array(F.concat(F.lit("q:"), F.substring(name_sq, 1, cfg.prefix)))).otherwise(F.array().cast("array<string>"))


def bag_keys(words: Column) -> Column:
    return F.when(F.size(words) >= 3, F.array(F.concat(F.lit("x:"), F.array_join(F.array_sort(words), " ")))).otherwise(F.array().cast("array<string>"))


def number_word_keys(words: Column) -> Column:
    d = F.array_distinct(words)
    return _tag("h", _pairs(F.filter(d, has_digit), F.filter(d, lambda t: ~has_digit(t))))


def cross_keys(names: Column, words: Column) -> Column:
    return _tag("c", _pairs(F.array_distinct(names), F.array_distinct(F.filter(words, lambda t: ~has_digit(t)))))


def vocabulary(records: DataFrame, words: Column) -> DataFrame:
    """(country, t, df): in how many records of a country a word stands."""
    return records.select("country", F.explode(F.array_distinct(words)).alias("t")).groupBy("country", "t").agg(F.count("*").alias("df"))


def rarest(records: DataFrame, words: Column, vocab: DataFrame, k: int, name: str) -> DataFrame:
    """(id, ``name``): each record's ``k`` rarest words of the vocabulary, rarest first, ties by word.

    A vocabulary of checked size meets the words where they are; else its frequent words do, as a broadcast, and only
    the rare ones are joined by shuffle, so no task gets all the records of a common word.
    """
    each = records.select("id", "country", F.explode(F.array_distinct(words)).alias("t"))
    if (vocab.agg(F.sum(F.length("t") + 40)).first()[0] or 0) <= BROADCAST_BYTES:
        each = each.join(F.broadcast(vocab), ["country", "t"])
    else:
        often = F.broadcast(vocab.orderBy(F.desc("df"), "country", "t").limit(OFTEN))
        rest = each.join(often, ["country", "t"], "left_anti").join(vocab, ["country", "t"])
        each = each.join(often, ["country", "t"]).unionByName(rest)
    first = F.slice(F.sort_array(F.collect_list(F.struct("df", "t"))), 1, k)
    return each.groupBy("id").agg(F.transform(first, lambda x: x["t"]).alias(name))


def rare_pair_keys(records: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(id, country, key) of the unordered pairs of the rarest address words."""
    own = rarest(records, X.split_words(F.col("addr_n")), vocab, k, "w")
    keys = F.filter(F.flatten(F.transform("w", lambda a: F.transform("w", lambda b: F.when(a < b, F.concat(F.lit("p:"), a, F.lit("_"), b))))), lambda x: x.isNotNull())
    return records.select("id", "country").join(own, "id").select("id", "country", F.explode(keys).alias("key"))


def row_keys(cfg: KeyConfig) -> Column:
    """Every key that a record has on its own."""
    n, a = X.split_words(F.col("name_n")), X.split_words(F.col("addr_n"))
    out = [token_keys("n", n), token_keys("a", a), bigram_keys(n), squash_keys(F.col("name_sq"), cfg), bag_keys(a), number_word_keys(a)]
    return F.concat(*out, *([cross_keys(n, a)] if cfg.caps["c"] else []))


def all_keys(records: DataFrame, vocab: DataFrame, pair_words: int, cfg: KeyConfig) -> DataFrame:
    """(id, country, key), distinct."""
    own = records.select("id", "country", F.explode(F.array_distinct(row_keys(cfg))).alias("key"))
    return own.unionByName(rare_pair_keys(records, vocab, pair_words))


# keys that undo corruptions


def name_bag(name: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(X.split_words(name), X.leet)))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once a row: inside lambdas an expression is computed again for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def subsets(bag: Column, deletions: int) -> Column:
    """struct(d, words) for the bag less d words: up to two for seven words or fewer, one beyond, never all."""

    def of(b: Column) -> Column:
        n = F.size(b)
        most = F.least(F.when(n <= 7, deletions).otherwise(F.lit(min(deletions, 1))), n - 1)

        # position n stands for "none": (n, n) deletes nothing, (i, n) one word, (i, j) two
        def cut(i: Column, j: Column) -> Column:
            d = (i < n).cast("int") + ((j < n) & (j != i)).cast("int")
            return F.struct(d.alias("d"), F.filter(b, lambda t, k: (k != i) & (k != j)).alias("words"))

        ends = lambda i: F.when(i == n, F.array(n)).when((most < 2) | (i + 1 >= n), F.array(n)).otherwise(F.sequence(i + 1, n))
        rows = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(ends(i), lambda j: cut(i, j))))
        return F.filter(rows, lambda x: (x["d"] <= most) & (F.size(x["words"]) > 0))

    return _once(bag, of)


def bag_subset_keys(name: Column, stop: Column, deletions: int, families: tuple[str, ...] = ("nb", "ag")) -> Column:
    """Keys of the bag's subsets by their words ("nb"), and by their letters of those less one word at most ("ag")."""

    def of(sets: Column) -> Column:
        kept = F.filter(sets, lambda x: ~((F.size(x["words"]) == 1) & F.array_contains(stop, F.get(x["words"], F.lit(0)))))
        letters = lambda ws: F.array_join(F.sort_array(F.split(F.array_join(ws, ""), "")), "")
        made = {
            "nb": lambda: F.transform(kept, lambda x: F.concat(F.lit("nb:"), F.array_join(x["words"], " "))),
            "ag": lambda: F.transform(F.filter(kept, lambda x: x["d"] <= 1), lambda x: F.concat(F.lit("ag:"), letters(x["words"]))),
        }
        return F.array_distinct(F.concat(*[made[f]() for f in families]))

    # letters need the bag less one word at most
    return _once(subsets(name_bag(name), deletions if "nb" in families else min(deletions, 1)), of)


def name_keys(name: str, stop: set[str], deletions: int) -> list[str]:
    """``bag_subset_keys`` and ``typo_keys`` of one name. ``stop``: words that make no key alone."""
    bag = sorted({leet(t) for t in name.split(" ") if t})
    n, out = len(bag), {}
    for d in range(min(deletions if n <= 7 else min(deletions, 1), n - 1) + 1):
        for words in combinations(bag, n - d):
            if n - d == 1 and words[0] in stop:
                continue
            out["nb:" + " ".join(words)] = None
            if d <= 1:
                out["ag:" + "".join(sorted("".join(words)))] = None
    for t in bag:
        if t not in stop and _SMALL.search(t):
            out["ty:" + t] = None
            if len(t) >= 5:
                out.update(dict.fromkeys(f"ty:{t[:i]}{t[i + 1 :]}" for i in range(len(t))))
    return [*out]


_SMALL, _ORDINAL, _DIGIT = re.compile("[a-z]"), re.compile("^[0-9]+(st|nd|rd|th)$"), re.compile("[0-9]")
_LEET = str.maketrans("0123456789", "olzeasgtbg")


def leet(t: str) -> str:
    """``text.leet`` of one word."""
    return t.translate(_LEET) if _DIGIT.search(t) and _SMALL.search(t) and not _ORDINAL.match(t) else t


def distinct_name_keys(records: DataFrame, stop: DataFrame, deletions: int) -> DataFrame:
    """(country, name_n, keys): the name families' keys, made once for each name of a country."""

    @F.pandas_udf("array<string>")
    def run(names: pd.Series, stops: pd.Series) -> pd.Series:
        sets: dict[bytes, set[str]] = {}  # of a few countries
        out = []
        for name, words in zip(names, stops, strict=True):
            mark = "\n".join(words)
            if mark not in sets:
                sets[mark] = {*words}
            out.append(name_keys(name, sets[mark], deletions))
        return pd.Series(out)

    names = records.groupBy("country", "name_n").agg(F.count("*").alias("n")).join(F.broadcast(stop), "country", "left")
    return names.select("country", "name_n", run(F.coalesce("name_n", F.lit("")), F.coalesce("stop", F.array().cast("array<string>"))).alias("name_keys"))


def _deletions(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))


def typo_keys(name: Column, stop: Column) -> Column:
    more = lambda words: F.flatten(F.transform(F.filter(words, lambda t: F.length(t) >= 5), _deletions))
    own = F.filter(name_bag(name), lambda t: t.rlike("[a-z]") & ~F.array_contains(stop, t))
    return _once(own, lambda words: F.array_distinct(_tag("ty", F.concat(words, more(words)))))


def house_numbers(addr: Column) -> Column:
    """The first three numbers without leading zeros, and those of three digits or more less any one of the first eight digits."""
    runs = F.filter(F.transform(F.regexp_extract_all(addr, F.lit("(?U)\\d+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+", "")), lambda x: x != "")
    cut = lambda t: F.slice(_deletions(t), 1, 8)
    return _once(F.array_distinct(F.slice(runs, 1, 3)), lambda first: F.array_distinct(F.concat(first, F.flatten(F.transform(F.filter(first, lambda t: F.length(t) >= 3), cut)))))


def corruption_keys(records: DataFrame, names: DataFrame, words: DataFrame, stop: DataFrame, reference: bool, cfg: CorruptionConfig, name_families: bool = True) -> DataFrame:
    """(id, country, fam, key): all families, or those of addresses alone; ``names`` and ``words`` are vocabularies, ``stop`` is (country, stop)."""
    plain_words = F.filter(X.split_words(F.col("addr_n")), lambda t: ~has_digit(t))
    leet_names = F.transform(X.split_words(F.col("name_n")), X.leet)
    w = rarest(records, plain_words, words, cfg.words_reference if reference else cfg.words, "w")
    r = rarest(records, leet_names, names, cfg.names, "r")
    own = records.join(w, "id", "left").join(r, "id", "left")
    none = F.array().cast("array<string>")
    w, r = (F.coalesce(c, none) for c in ("w", "r"))
    glued = X.leet(F.col("name_sq"))
    sw = F.when(F.length(glued) >= 5, F.array(F.substring(glued, 1, 10))).otherwise(none)
    keys = [
        _once(house_numbers(F.col("addr_n")), lambda h: _tag("hn", _pairs(h, w))),
        _tag("cx", _pairs(r, w)),
        _tag("sw", _pairs(sw, w)),
    ]
    if name_families:
        # a name that many records have is one row of the names; AQE deals out its records
        own = own.join(distinct_name_keys(records, stop, cfg.deletions), ["country", "name_n"], "left")
        keys.insert(0, F.coalesce("name_keys", none))
    return own.select("id", "country", F.explode(F.array_distinct(F.concat(*keys))).alias("key")).withColumn("fam", F.substring_index("key", ":", 1))
