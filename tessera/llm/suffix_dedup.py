"""Exact substring dedup with suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier is removed. Strings that are equal
must meet, so texts are split into regions by content: a string's key is the least hash of the GRAM-byte
grams inside it, and a region is a maximal run of strings with one key. Equal regions are one text with its
first place; each further place is a repeat as a whole. Regions that share a key, or hold it twice, go to
the shard of that key.

A shard's task takes its regions in order of place, in blocks. Each block gets a suffix array by
Larsson-Sadakane refinement (ranks doubled, only unresolved groups sorted again) and common prefixes by
Kasai's diagonals; runs with common prefixes of LENGTH bytes are equal strings, of which the first place
stays. Blocks of one key are merged by binary search of a block's strings in the sorted strings before it.

Keys with many regions are hot. They are found by a count over all partitions of one region in EVERY, chosen by its
own hash, and split into single strings keyed by their own hash, so that no task gets all regions around one frequent
phrase. A key is hot from LEAST counted regions on, in large corpora from one in HOT of all, so there are never more
than HOT hot keys. The count only deals out work. Regions are compared by 128 bits, strings inside a shard byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytescan
from tessera.llm.common import small_batches, stored, table

LENGTH = 100
GRAM = 32
EVERY, LEAST, HOT = 64, 64, 1 << 20
#: Region rows that a task holds at once, and bytes of a suffix array's text.
HELD, BLOCK = 2 << 20, 1 << 20
#: Rows of documents' spans or ids that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_IDS, BROADCAST_SPANS = 1 << 20, 1 << 20
U = np.uint64
I64 = pa.int64()


def regions(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start in data, strings, key, print, twice) of all regions of some texts laid end to end."""
    n = len(data)
    size = np.diff(offsets)
    if not (size >= LENGTH).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, bool))
    c = bytescan.sums(data)
    at = np.arange(n - gram + 1)
    h = bytescan.span_hash(c, at, at + gram)
    least, width, w = h, 1, LENGTH - gram + 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    # strings that lie inside one text, and where a new run begins
    text = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0)
    start = np.arange(len(text)) - first[text] + offsets[text]
    key = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(start)))
    s, k = start[run], key[run]
    prints = bytescan.span_hash(c, s, s + count + LENGTH - 1)
    # a string can recur inside its region only if the key's gram does: count the places of the key
    place = np.repeat(s, count + LENGTH - gram) + _ramp(count + LENGTH - gram)
    same = np.add.reduceat(h[place] == np.repeat(k, count + LENGTH - gram), np.cumsum(count + LENGTH - gram) - (count + LENGTH - gram), dtype=np.int64)
    return text[run], s, count, k, prints, same > 1


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first LENGTH bytes, common prefixes with the suffix before, at most LENGTH).

    ``data`` must end with 2 * LENGTH bytes that do not count.
    """
    n = len(data) - 2 * LENGTH
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    first = np.zeros(len(data), U)
    for j in range(8):
        first = (first << U(8)) | wide[j : j + len(data)]
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(data), np.int64)
    sorted_first = first[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_first[1:] != sorted_first[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    for step in (8, 16, 32, LENGTH - 64):
        # only groups of more than one suffix are sorted again
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        todo = order[slots]
        ahead = rank[np.minimum(todo + step, len(data) - 1)]
        by = (rank[todo].astype(U) << U(32)) | ahead.astype(U)
        sort = np.argsort(by, kind="stable")
        order[slots] = todo[sort]
        by = by[sort]
        change = np.ones(len(by), bool)
        change[1:] = by[1:] != by[:-1]
        new[slots] = change
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[order[slots]] = head[slots]
    # Kasai: along text order the prefix shared with the neighbour shrinks by one a step at most
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    prev = before[:n]
    equal = (prev >= 0) & (data[:n] == data[np.maximum(prev, 0)])
    follows = np.zeros(n, bool)
    follows[:-1] = equal[:-1] & (prev[1:] == prev[:-1] + 1)
    ends = np.flatnonzero(~follows)
    shared = np.zeros(len(ends), np.int64)
    live = np.flatnonzero(equal[ends])
    for d in range(LENGTH):
        i = ends[live]
        live = live[data[i + d] == data[np.minimum(prev[i] + d, len(data) - 1)]]
        if not len(live):
            break
        shared[live] = d + 1
    which = np.searchsorted(ends, at)
    plcp = np.minimum(ends[which] - at + shared[which], LENGTH)
    plcp[~equal] = 0
    order = order[order < n]
    return order, plcp[order]


def repeats(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions, of those marked ``inside``, whose LENGTH bytes also begin at an earlier marked position."""
    order, lcp = suffix_array(np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)]))
    # a suffix beside ours in the array may be unmarked; a run of equal ones holds together all the same
    group = np.cumsum(lcp < LENGTH)
    marked = inside[order]
    order, group = order[marked], group[marked]
    least = np.full(group.max(initial=0) + 1, len(data), np.int64)
    np.minimum.at(least, group, order)
    return order[order != least[group]]


class _Held:
    """Region rows of a partition, columns doc, start, strings, key, print, twice."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *cols: np.ndarray) -> bool:
        self.parts.append(cols)
        self.size += len(cols[0])
        return self.size >= HELD

    def take(self) -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        return cols


def _collapse(doc, start, count, key, prints, twice) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(first places of distinct regions in order of key, further places) of some rows."""
    cols = [doc, start, count, key, prints, twice]
    order = np.lexsort((start, doc, prints, key))
    cols = [c[order] for c in cols]
    doc, start, count, key, prints, _ = cols
    new = np.ones(len(doc), bool)
    new[1:] = (key[1:] != key[:-1]) | (prints[1:] != prints[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    again = (doc != doc[head]) | (start != start[head])
    return [c[new] for c in cols], [c[again] for c in cols]


def _merged(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Repeats with those that follow each other in a document as one."""
    order = np.lexsort((cols[1], cols[0]))
    doc, start, count = (c[order] for c in cols[:3])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])
    at = np.flatnonzero(new)
    return [doc[at], start[at], np.add.reduceat(count, at) if len(at) else count, *(c[order][at] for c in cols[3:])]


_FIELDS = ["doc_id", "start", "strings", "key", "print", "twice", "state"]
_SCHEMA = "doc_id long, start long, strings long, key long, print long, twice boolean, state int"
#: state: 0 a first place still to be compared, 1 a repeat, 2 to be sorted in a shard
FIRST, REPEAT, SORT = 0, 1, 2


def _rows(cols: list[np.ndarray], state: np.ndarray | int) -> pa.RecordBatch:
    doc, start, count, key, prints, twice = cols
    state = np.full(len(doc), state, np.int32) if isinstance(state, int) else state
    arrays = [pa.array(x, I64) for x in (doc, start, count, key.view(np.int64), prints.view(np.int64))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(twice), pa.array(state, pa.int32())], names=_FIELDS)


def _split_hot(found, data, offsets, heavy: np.ndarray):
    """The regions, those with a hot key as single strings keyed by their own hash."""
    text, s, count, key, prints, twice = found
    if not len(heavy) or not len(key):
        return found
    hot = heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key
    if not hot.any():
        return found
    n = count[hot]
    at = np.repeat(s[hot], n) + _ramp(n)
    own = bytescan.span_hash(bytescan.sums(data), at, at + LENGTH)
    other = bytescan.span_hash(bytescan.sums(data ^ np.uint8(0x5A)), at, at + LENGTH)
    one = np.ones(len(at), np.int64)
    new = (np.repeat(text[hot], n), at, one, bytescan.mix(other), own, one < 0)
    return tuple(np.concatenate([a[~hot], b]) for a, b in zip(found, new, strict=True))


def hot_keys(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> np.ndarray:
    """The keys with many distinct regions, by those regions whose print is 0 modulo ``every``; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in bytescan.blocks(batch.column(0)):
                found = regions(data, offsets)
                some = found[4] % U(every) == 0
                key, prints = _distinct_first(found[3][some], found[4][some])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), I64) for x in (key, prints)], names=["key", "print"])

    rows = docs.select("text").mapInArrow(run, "key long, print long").distinct().groupBy("key").agg(F.count("*").alias("n"))
    counts = stored(rows.where(F.col("n") >= least))
    most = max(least, -(-(counts.agg(F.sum("n")).first()[0] or 0) // HOT))
    return np.sort(counts.where(F.col("n") >= most).select("key").toArrow().column("key").to_numpy().astype(np.int64).view(U))


def _distinct_first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def places(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``_SCHEMA`` rows: distinct regions of each partition at their first place (FIRST), and its further places (REPEAT)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, _, data, offsets in bytescan.blocks(batch.column(1)):
                text, s, count, key, prints, twice = _split_hot(regions(data, offsets), data, offsets, shared.value)
                if held.add(ids[at + text], s - offsets[text], count, key, prints, twice):
                    first, again = _collapse(*held.take())
                    yield _rows(first, FIRST)
                    yield _rows(_merged(again), REPEAT)
        if held.size:
            first, again = _collapse(*held.take())
            yield _rows(first, FIRST)
            yield _rows(_merged(again), REPEAT)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def compared(rows: DataFrame) -> DataFrame:
    """REPEAT rows, and SORT rows for regions that share their key with another or hold it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            c = [b.column(j).to_numpy(zero_copy_only=False) for j in range(7)]
            again = c[6] == REPEAT
            yield b.filter(pa.array(again))
            if (~again).any():
                held.add(*[x[~again] for x in (c[0], c[1], c[2], c[3].astype(np.int64).view(U), c[4].astype(np.int64).view(U), c[5].astype(bool))])
        if held.size:
            first, again = _collapse(*held.take())
            yield _rows(_merged(again), REPEAT)
            key = first[3]
            near = np.zeros(len(key), bool)
            near[1:] = key[1:] == key[:-1]
            near[:-1] |= near[1:].copy()
            yield _rows([x[near | first[5]] for x in first], SORT)

    # repeats are only carried along, so they go anywhere
    dealt = F.when(F.col("state") == FIRST, F.col("key")).otherwise(F.xxhash64("doc_id", "start"))
    return rows.repartition(dealt).mapInArrow(run, _SCHEMA)


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, doc_id, start, strings, bytes) of the SORT rows."""
    wanted = rows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "strings")).alias("r"))
    ids = rows.select("doc_id").distinct()
    n = ids.count()
    own = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    own = own.join(F.broadcast(ids), "doc_id", "left_semi") if n <= BROADCAST_IDS else own
    joined = own.join(wanted, "doc_id").select("doc_id", "data", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data, r = data.as_py(), r.values.flatten()
                key, start, count = r
                parts = [data[s : s + n + LENGTH - 1] for s, n in zip(start.to_pylist(), count.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key, pa.array([doc] * len(parts), I64), start, count, pa.array(parts, pa.binary())], names=["key", "doc_id", "start", "strings", "data"])

    return joined.mapInArrow(run, "key long, doc_id long, start long, strings long, data binary")


def sorted_repeats(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """(doc_id, start, strings): runs of repeated strings among the regions of each key."""

    def strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = np.zeros(0, f"S{LENGTH}"), None  # sorted strings of the key that goes on

        def block(held: list) -> pa.RecordBatch:
            nonlocal before, last
            data = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
            count = np.array([h[3] for h in held])
            size = count + LENGTH - 1
            base = np.cumsum(size) - size
            inside = np.zeros(len(data), bool)
            at = np.repeat(base, count) + _ramp(count)
            inside[at] = True
            found = np.zeros(len(data), bool)
            found[repeats(data, inside)] = True
            ends = held[-1][0]
            if held[0][0] == last and len(before):
                own = np.concatenate([base[i] + np.arange(count[i]) for i in range(len(held)) if held[i][0] == last])
                s = strings(data, own)
                k = np.minimum(np.searchsorted(before, s), len(before) - 1)
                found[own[before[k] == s]] = True
            own = np.concatenate([base[i] + np.arange(count[i]) for i in range(len(held)) if held[i][0] == ends])
            new = np.unique(strings(data, own))
            before = np.unique(np.concatenate([before, new])) if ends == last else new
            last = ends
            region = np.repeat(np.arange(len(held)), count)
            hit = found[at]
            region, place = region[hit], (at - base[np.repeat(np.arange(len(held)), count)])[hit]
            new = np.ones(len(region), bool)
            new[1:] = (region[1:] != region[:-1]) | (place[1:] != place[:-1] + 1)
            run_at = np.flatnonzero(new)
            n = np.diff(np.append(run_at, len(region)))
            docs, starts = np.array([h[1] for h in held]), np.array([h[2] for h in held])
            return pa.RecordBatch.from_arrays([pa.array(docs[region[run_at]], I64), pa.array(starts[region[run_at]] + place[run_at], I64), pa.array(n, I64)], names=["doc_id", "start", "strings"])

        held, size, place = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] == place:  # a row of documents that is there twice
                    continue
                place = row[:3]
                held.append(row)
                size += len(row[4])
                if size >= most:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(run, "doc_id long, start long, strings long")


def removed_spans(docs: DataFrame, block: int = BLOCK, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(doc_id, spans): the maximal byte runs to remove from each document that has any, as (start, end)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = stored(compared(places(docs, hot_keys(docs, least, every))))
    near = sorted_repeats(with_text(docs, rows.where(f"state = {SORT}")), block)
    all_runs = rows.where(f"state = {REPEAT}").select("doc_id", "start", "strings").unionByName(near)
    per_doc = all_runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "strings")).alias("r"))
    kind = pa.list_(pa.struct([("start", I64), ("end", I64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column(1):
                start, n = (x.to_numpy(zero_copy_only=False) for x in r.values.flatten())
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start + n + LENGTH - 1)[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > end[:-1]
                at = np.flatnonzero(new)
                out.append([{"start": s, "end": e} for s, e in zip(start[at].tolist(), end[np.append(at[1:], len(start)) - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return per_doc.mapInArrow(run, "doc_id long, spans array<struct<start: bigint, end: bigint>>")


def with_spans(docs: DataFrame, block: int = BLOCK, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans`` (null where nothing goes).

    Texts are UTF-8 bytes, null texts empty. Rows without doc_id keep everything and are no earlier place
    for others. Rows that repeat a doc_id with the same text count as one document; those with different texts are
    documents of their own, one after the other in the order of a hash of their texts.
    """
    mark = F.xxhash64("text")
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").isEmpty():
        return _joined(docs, docs.select("doc_id", "text"), "doc_id", block, least, every)
    # numbers that ascend by doc_id and hash, one for each text of a doc_id
    texts = known.select("doc_id", mark.alias("_mark")).distinct()
    numbers = stored(texts.repartitionByRange("doc_id", "_mark").sortWithinPartitions("doc_id", "_mark").withColumn("_number", F.monotonically_increasing_id()))
    own = stored(docs.withColumn("_mark", mark).join(numbers, ["doc_id", "_mark"], "left").select(*docs.columns, "_number"))
    return _joined(own, own.select(F.col("_number").alias("doc_id"), "text"), "_number", block, least, every).drop("_number")


def _joined(docs: DataFrame, texts: DataFrame, by: str, block: int, least: int, every: int) -> DataFrame:
    with small_batches(docs.sparkSession):
        spans = stored(removed_spans(texts, block, least, every))
    n, m = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    small = n <= BROADCAST_IDS and m <= BROADCAST_SPANS
    spans = spans.withColumnRenamed("doc_id", by)
    return docs.join(F.broadcast(spans) if small else spans, by, "left")


def digest(rows: DataFrame) -> DataFrame:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(b.column(1), b.column(2), strict=True):
                data, spans = data.as_py() or b"", spans.as_py() or []
                sha, at = hashlib.sha256(), 0
                for s in spans:
                    sha.update(data[at : s["start"]])
                    at = s["end"]
                sha.update(data[at:])
                out.append((len(data), sum(s["end"] - s["start"] for s in spans), len(spans), sha.hexdigest()))
            cols = [*zip(*out, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([*c], t) for c, t in zip(cols, (I64, I64, I64, pa.string()), strict=True))], names=names)

    return rows.select("doc_id", F.col("text").cast("binary").alias("data"), "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
