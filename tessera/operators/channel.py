"""Noisy-channel evidence: what edits turn an entity's text into a query's, and how they tell matches from others.

Events of a pair come from an Arrow kernel; counting, log-likelihood ratios and features are aggregates.
Edit scripts are read from the end and prefer replacing, then deleting, then inserting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.stored import stored

GROUPS = ["nop", "nins", "ndel", "aop", "ains", "adel"]
MOST_REST = 6
SIMILAR = 0.5
#: Cells of the tables that are held at a time.
TABLE_CELLS = 1 << 22
_EVENTS = T.ArrayType(T.StructType([T.StructField("g", T.StringType()), T.StructField("event", T.StringType())]))


def char_class(c: str) -> str:
    return "$" if not c else "D" if c.isdigit() else "V" if c in "aeiou" else "C" if "a" <= c <= "z" else "N"


def _codes(words: list[str], width: int) -> np.ndarray:
    """Characters of words as numbers, 0 behind the end."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _alike(pairs: list[tuple[str, str]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(which, left and right characters) of pairs of about the same lengths, so that padding is little."""
    by: dict[tuple[int, int], list[int]] = {}
    for k, (s, q) in enumerate(pairs):
        by.setdefault((len(s) + 3 & ~3 or 4, len(q) + 3 & ~3 or 4), []).append(k)
    for (w1, w2), every in by.items():
        most = max(1, TABLE_CELLS // ((w1 + 1) * (w2 + 1)))
        for at in range(0, len(every), most):
            ks = every[at : at + most]
            yield ks, _codes([pairs[k][0] for k in ks], w1), _codes([pairs[k][1] for k in ks], w2)


def _rows(s: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of all pairs' tables of edit distances between beginnings, one after the other."""
    step = np.arange(q.shape[1] + 1)
    row = np.tile(step, (len(s), 1))
    yield row
    for i in range(s.shape[1]):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (s[:, i : i + 1] != q), out=new[:, 1:])
        row = np.minimum.accumulate(new - step, 1) + step  # insertions run along the row
        yield row


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The edit distance of every pair of words."""
    out = np.zeros(len(pairs), np.int64)
    for ks, s, q in _alike(pairs):
        n1, n2 = (np.array([len(pairs[k][j]) for k in ks]) for j in (0, 1))
        for i, row in enumerate(_rows(s, q)):
            at = np.flatnonzero(n1 == i)
            out[np.array(ks)[at]] = row[at, n2[at]]
    return out


def edit_scripts(pairs: list[tuple[str, str]]) -> list[list[tuple[str, str, int]]]:
    """For every pair of words (from, to, place in the first) of the edits of one shortest script, '' for nothing."""
    out: list[list[tuple[str, str, int]]] = [[] for _ in pairs]
    for ks, s, q in _alike(pairs):
        d = np.stack([*_rows(s, q)], 1)
        i, j = (np.array([len(pairs[k][c]) for k in ks]) for c in (0, 1))
        at = np.arange(len(ks))
        while len(at := at[(i[at] > 0) | (j[at] > 0)]):
            x, y = i[at], j[at]
            here, both = d[at, x, y], (x > 0) & (y > 0)
            differ = s[at, x - 1] != q[at, y - 1]
            same = both & (here == d[at, x - 1, y - 1] + differ)
            gone = ~same & (x > 0) & (here == d[at, x - 1, y] + 1)
            i[at] -= same | gone
            j[at] -= ~gone
            edit = np.flatnonzero(~same | differ)
            for k, g, c in zip(at[edit].tolist(), gone[edit].tolist(), same[edit].tolist(), strict=True):
                a, b = pairs[ks[k]]
                out[ks[k]].append((a[i[k]] if g or c else "", "" if g else b[j[k]], int(i[k])))
    return [x[::-1] for x in out]


def script_events(s: str, script: list[tuple[str, str, int]]) -> list[str]:
    """Each edit of ``s`` as itself and as a change of character classes with its place: start, middle or end."""
    out = []
    for a, b, at in script:
        place = "S" if at == 0 else "E" if at >= len(s) - 1 else "M"
        out += [f"{a}>{b}", f"{char_class(a)}>{char_class(b)}@{place}"]
    return out


def _word(t: str) -> str:
    return f"#num{len(t)}" if t.isdigit() else t


def _rest(s: str, q: str) -> tuple[list[str], list[str]]:
    """The words either side lacks, in order and distinct."""
    x, y = s.split(" "), q.split(" ")
    return [*dict.fromkeys(t for t in x if t and t not in y)], [*dict.fromkeys(t for t in y if t and t not in x)]


def field_events(fields: list[tuple[str, str]]) -> list[tuple[list[str], list[str], list[str]]]:
    """(edits, inserted words, deleted words) of every pair of texts: a word goes with the most similar free word, if they are similar at all.

    Each pair of words is compared once in a batch, all of them in the same tables, and so are the scripts of those that go together.
    """
    rests = [_rest(s, q) for s, q in fields]
    many = [max(len(a), len(b)) > MOST_REST for a, b in rests]
    words = [*dict.fromkeys((x, t) for (a, b), m in zip(rests, many, strict=True) if not m for t in b for x in a)]
    far = dict(zip(words, distances(words).tolist(), strict=True))
    linked: list[list[tuple[str, str]]] = []
    out: list[tuple[list[str], list[str], list[str]]] = []
    for (a, b), m in zip(rests, many, strict=True):
        free, ins, met = a[:], [], []
        for t in b if not m else []:
            scored = [(1 - far[x, t] / max(len(x), len(t)), -k) for k, x in enumerate(free)]
            top = max(scored, default=(0.0, 0))
            if scored and top[0] >= SIMILAR:
                met.append((free.pop(-top[1]), t))
            else:
                ins.append(_word(t))
        linked.append(met)
        out.append((["#many"], [], []) if m else ([], ins, [_word(t) for t in free]))
    each = [*dict.fromkeys(p for met in linked for p in met)]
    events = {p: script_events(p[0], x) for p, x in zip(each, edit_scripts(each), strict=True)}
    for met, (ops, _, _) in zip(linked, out, strict=True):
        for p in met:
            ops += events[p]
    return out


def with_events(t: DataFrame) -> DataFrame:
    """Adds ``events``: array of (group, event) of name and address."""

    @F.pandas_udf(_EVENTS)
    def run(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.Series:
        n1, n2, a1, a2 = (x.fillna("").tolist() for x in (n1, n2, a1, a2))
        found = field_events([*zip(n1, n2, strict=True), *zip(a1, a2, strict=True)])
        names, addresses = found[: len(n1)], found[len(n1) :]
        return pd.Series([[{"g": g, "event": e} for g, es in zip(GROUPS, (*n, *a), strict=True) for e in es] for n, a in zip(names, addresses, strict=True)])

    return t.withColumn("events", run("n1", "n2", "a1", "a2"))


def llr_table(events: DataFrame, least: int = 5) -> DataFrame:
    """(g, event, pos, neg, llr) from rows (q_id, s1_id, label, events): in how many pairs of each label an event is present."""
    return _llr(events.withColumn("_k", F.lit(0)), least, whole=True).where("fold is null").drop("fold")


def fold_tables(events: DataFrame, least: int = 5) -> DataFrame:
    """``llr_table`` for every fold without that fold's pairs, and of all pairs (fold null), from one count."""
    return _llr(events.withColumn("_k", F.col("fold")), least, whole=False)


def _llr(events: DataFrame, least: int, whole: bool) -> DataFrame:
    pairs = events.groupBy("_k").agg(F.sum("label").alias("kp"), F.sum(1 - F.col("label")).alias("kn"))
    each = events.select("q_id", "s1_id", "_k", "label", F.explode(F.array_distinct("events")).alias("x")).select("_k", "label", "x.*")
    own = each.groupBy("g", "event", "_k").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    total = own.groupBy("g", "event").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    sums = pairs.agg(F.sum("kp").alias("ap"), F.sum("kn").alias("an"))
    full = total.crossJoin(F.broadcast(sums)).select(F.lit(None).cast("int").alias("fold"), "g", "event", F.col("tp").alias("pos"), F.col("tn").alias("neg"), "ap", "an")
    if not whole:
        folds = pairs.crossJoin(F.broadcast(sums)).select(F.col("_k").cast("int").alias("fold"), (F.col("ap") - F.col("kp")).alias("ap"), (F.col("an") - F.col("kn")).alias("an"))
        rest = total.crossJoin(F.broadcast(folds)).join(own.withColumn("fold", F.col("_k").cast("int")).drop("_k"), ["g", "event", "fold"], "left").na.fill(0, ["p", "n"])
        full = full.unionByName(rest.select("fold", "g", "event", (F.col("tp") - F.col("p")).alias("pos"), (F.col("tn") - F.col("n")).alias("neg"), "ap", "an"))
    llr = F.log((F.col("pos") + 1) / (F.col("ap") + 1)) - F.log((F.col("neg") + 1) / (F.col("an") + 1))
    return full.where(F.col("pos") + F.col("neg") >= least).withColumn("llr", llr).drop("ap", "an")


#: Rows of a task that sums their events; a table of events is broadcast up to so many bytes, counted, beyond, its OFTEN most frequent events are.
ROWS_A_TASK = 500_000
BROADCAST_BYTES = 32 << 20
OFTEN = 100_000


def channel_features(events: DataFrame, table: DataFrame) -> DataFrame:
    """(q_id, s1_id, and for each group sum, min, count, unknown): ``table`` is (g, event, llr); min is null if no event is known."""
    return _by_group(events, stored(table.select("g", "event", "llr")), ["g", "event"])


def cross_fitted(events: DataFrame, fit: Column, least: int = 5) -> DataFrame:
    """``channel_features`` by tables that have not seen the row: rows (with label and fold ``sub``) that ``fit`` holds for use the table of
    all such rows but their own fold's, the others that of all such rows.
    """
    tables = stored(fold_tables(events.where(fit).withColumn("fold", F.col("sub")), least).select(F.coalesce("fold", F.lit(-1)).alias("_t"), "g", "event", "llr"))
    return _by_group(events.withColumn("_t", F.when(fit, F.col("sub")).otherwise(-1).cast("int")), tables, ["_t", "g", "event"])


def _by_group(events: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """Rows are dealt out by pair before their events are opened, in tasks of counted rows: no task gets all the rows of a frequent event."""
    tasks = max(1, -(-events.count() // ROWS_A_TASK))
    own = events.select("q_id", "s1_id", *by[:-2], "events").repartition(tasks, "q_id", "s1_id")
    each = own.select("q_id", "s1_id", *by[:-2], F.posexplode_outer("events").alias("_at", "x")).select("q_id", "s1_id", *by[:-2], "_at", "x.*")
    if (tables.agg(F.sum(F.length("event") + 60)).first()[0] or 0) <= BROADCAST_BYTES:
        each = each.join(F.broadcast(tables), by, "left")
    else:
        many = each.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *by).limit(OFTEN)
        often = F.broadcast(stored(many.join(tables, by, "left").select(*by, "llr", F.lit(True).alias("_often"))))
        met = each.join(often, by, "left")
        rest = met.where("_often is null").drop("llr", "_often").join(tables, by, "left")
        each = met.where("_often").drop("_often").unionByName(rest).repartition(tasks, "q_id", "s1_id")
    aggs = []
    for g in GROUPS:
        here = F.col("g") == g
        aggs += [F.coalesce(F.sum(F.when(here, F.col("llr"))), F.lit(0.0)).alias(f"{g}_sum"), F.min(F.when(here, F.col("llr"))).alias(f"{g}_min"), F.count_if(here).alias(f"{g}_n"), F.count_if(here & F.col("llr").isNull()).alias(f"{g}_unknown")]
    # a row's first event, or its lack of any, stands for the row: a pair that has several rows is one row for each
    got = each.groupBy("q_id", "s1_id").agg(*aggs, F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_rows"))
    return got.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_rows", "_row")


def first_owner(scored: DataFrame) -> DataFrame:
    """The best candidate of each row's query."""
    return scored.withColumn("owner", F.first(F.when(F.col("q_rank") == 0, F.col("s1_id")), ignorenulls=True).over(Window.partitionBy("q_id")))
