"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

A text is its set of distinct 5-word shingles. Equal sets are one class, and one document stands for it.

First, documents that can have no partner leave. In the order of hashes, two sets that reach the threshold share
their first k common shingles within prefixes longer by k - 1 than usual, so a document without that many shingles
that others have in such prefixes is out. What stays gets the one global order, rare first, by the frequency of
every shingle among them; shingles that only one document has come first and need no posting.

Only prefix postings are joined. Length, position and suffix filters drop what cannot reach the threshold, and each
remaining pair is verified once on the whole sets; verified links give components. A shingle that many texts share
is first joined to one centre. Pairs inside one component so found need no verification; what is left are pairs
of different components, and these are all joined. So no link between components is lost, and a group of copies
never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytescan
from tessera.llm.common import bitmap, components, dropped, in_bitmap, small_batches, stored, table

SIZE = 5
#: Similarity threshold in hundredths.
PERCENT = 75
#: Of every so many shingles one more must be shared in the hash-ordered prefix, which is longer by as many.
EXTRA = 10
#: Ids of documents (16 bytes each with a print) are broadcast up to this many, else joined by shuffle.
BROADCAST_IDS = 1 << 20
#: A document in more pairs than this is joined in parts of this many.
FAN = 2000
#: Shingles that a worker handles at a time.
PART = 1 << 18
#: Longs of the signature that suffix filters compare.
SIGNATURE = 8
U = np.uint64
I64 = pa.int64()


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), I64)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, values, index, prints) of runs of rows (text, ...): each row's distinct shingle hashes, ascending, and 128 bits for each set."""
    for at, n, data, offsets in bytescan.blocks(batch.column(0)):
        text, value = bytescan.shingles(data, offsets, SIZE)
        value, index = bytescan.distinct_sets(text, value, n)
        total = [np.concatenate([[U(0)], np.cumsum(bytescan.mix(value ^ U(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        f1, f2 = (t[index[1:]] - t[index[:-1]] for t in total)
        yield batch.slice(at, n), value, index, f1, f2


def summaries(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its set's size and 128-bit print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, index, f1, f2 in _sets(batch):
                yield pa.RecordBatch.from_arrays([rows.column(1), _longs(np.diff(index)), _longs(f1), _longs(f2)], names=["doc_id", "n", "f1", "f2"])

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, doc_id, f1) of the rows of ``docs`` with a (doc_id, f1) in ``ids``; a row of that doc_id with another text is told apart by its print later."""
    ids = ids.select("doc_id", "f1")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, "doc_id").select("text", "doc_id", "f1")


def _least(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n can have with a partner."""
    return -(-n * PERCENT // 100)


def prefix_hashes(docs: DataFrame) -> DataFrame:
    """(hash): the shingles in the hash-ordered, longer prefixes of ``only``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, value, index, *_ in _sets(batch):
                yield pa.RecordBatch.from_arrays([_longs(value[_in_prefix(index)])], names=["hash"])

    return docs.mapInArrow(run, "hash long")


def _in_prefix(index: np.ndarray) -> np.ndarray:
    n = np.diff(index)
    width = n - _least(n) + 1 + n // EXTRA
    return np.arange(index[-1]) - np.repeat(index[:-1], n) < np.repeat(width, n)


def company(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id) of the rows of ``only`` that share enough of their longer prefixes (``shared``: hash) for a partner.

    Two partners share the first k common shingles in both prefixes, k by the smaller of both sets.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, value, index, *_ in _sets(batch):
                n = np.diff(index)
                needed = _least(n) // EXTRA + 1
                hit = _in_prefix(index) & in_bitmap(held.value, value)
                c = np.concatenate([[0], np.cumsum(hit)])
                text = np.repeat(np.arange(len(n)), n)
                hit &= (c[index[1:]] - c[index[:-1]] >= needed)[text]
                yield pa.RecordBatch.from_arrays([_longs(value[hit]), rows.column(1).take(pa.array(text[hit])), _longs(needed[text[hit]])], names=["hash", "doc_id", "needed"])

    rows = docs.mapInArrow(run, "hash long, doc_id long, needed long")
    counted = rows.join(shared, "hash", "left_semi").groupBy("doc_id").agg(F.count("*").alias("c"), F.max("needed").alias("needed"))
    return counted.where("c >= needed").select("doc_id")


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n, values): the sets, 8 bytes a shingle, of ``only``'s rows, once for each doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, value, index, f1, _ in _sets(batch):
                own = pa.array(rows.column(2).to_numpy() == f1.view(np.int64))
                values = pa.array([value[s:e].tobytes() for s, e in zip(index[:-1], index[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(1), _longs(np.diff(index)), values], names=["doc_id", "n", "values"]).filter(own)

    return docs.mapInArrow(run, "doc_id long, n long, values binary").dropDuplicates(["doc_id"])


def _slices(batch: pa.RecordBatch, size: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with PART items in all, or one longer row, and their rows' numbers of items."""
    end, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + PART, side="right")))
        yield batch.slice(at, to - at), size[at:to]
        at = to


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, n, shared): each document's shingles that others have too, as (df, hash), for documents of which these are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size in _slices(batch, batch.column(1).to_numpy()):
                value = np.frombuffer(b"".join(v.as_buffer() for v in part.column(2)), U)
                rows = pa.array(np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays([_longs(value), part.column(0).take(rows), part.column(1).take(rows)], names=["hash", "doc_id", "n"])

    each = sets.mapInArrow(run, "hash long, doc_id long, n long")
    df = each.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    rows = each.join(df, "hash").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "hash")).alias("shared"))
    return rows.where(f"100 * size(shared) >= {PERCENT} * n")


def postings(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, n, alone, pos) of the rare-first prefixes of ``shared_shingles``; ``alone`` shingles, which only this document has, come before all postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, size in (x for b in batches for x in _slices(b, np.diff(b.column(2).offsets.to_numpy()))):
            items = part.column(2).flatten()
            df, value = (items.field(k).to_numpy() for k in (0, 1))
            text = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((value, df, text))
            n = part.column(1).to_numpy()
            pos = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(n - size, size)
            keep = pos < np.repeat(n - _least(n) + 1, size)
            rows = pa.array(text[keep])
            own = [c.take(rows) for c in (part.column(0), part.column(1), _longs(n - size))]
            yield pa.RecordBatch.from_arrays([_longs(value[order][keep]), *own, _longs(pos[keep])], names=["hash", "doc_id", "n", "alone", "pos"])

    return docs.select("doc_id", "n", "shared").mapInArrow(run, "hash long, doc_id long, n long, alone long, pos long")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, s0, s1, ...): SIGNATURE longs, in which each shared shingle sets one bit."""
    names = [f"s{k}" for k in range(SIGNATURE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, size in (x for b in batches for x in _slices(b, np.diff(b.column(1).offsets.to_numpy()))):
            place = (bytescan.mix(part.column(1).flatten().field(1).to_numpy().view(U)) % U(64 * SIGNATURE)).astype(np.int64)
            bits = np.zeros((len(size), SIGNATURE), U)
            np.bitwise_or.at(bits, (np.repeat(np.arange(len(size)), size), place // 64), U(1) << (place % 64).astype(U))
            yield pa.RecordBatch.from_arrays([part.column(0), *(_longs(np.ascontiguousarray(bits[:, k])) for k in range(SIGNATURE))], names=["doc_id", *names])

    return docs.select("doc_id", "shared").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


#: What two postings of one shingle must satisfy for their sets to be able to reach the threshold.
_NEEDED = f"ceil({PERCENT} * (a.n + b.n) / {100 + PERCENT}.0)"
#: The shorter set, and either of equal ones, must meet in a shorter prefix: 2t / (1 + t) of it is common.
_INDEX = f"{{x}}.n - ceil({2 * PERCENT} * {{x}}.n / {100 + PERCENT}.0) + 1"
_FILTERS = [
    f"(a.n > b.n or a.pos < {_INDEX.format(x='a')}) and (b.n > a.n or b.pos < {_INDEX.format(x='b')})",
    f"100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)",
    f"least(a.pos - a.alone, b.pos - b.alone) + least(a.n - a.pos, b.n - b.pos) >= {_NEEDED}",
]
#: A bit that one signature has and the other lacks is a shingle that the other lacks, besides those it has alone.
_SUFFIX = [
    f"{x}.n - {x}.alone - ({' + '.join(f'bit_count({x}.s{k} & ~{y}.s{k})' for k in range(SIGNATURE))}) >= {_NEEDED}" for x, y in ("ab", "ba")
]


def candidates(left: DataFrame, right: DataFrame, conditions: list[str]) -> DataFrame:
    """(a, b, shared, nb): distinct pairs of documents (a of ``right``) whose postings meet and pass the filters, and how many do."""
    both = left.alias("a").join(right.alias("b"), F.col("a.hash") == F.col("b.hash"))
    for f in [*conditions, *_FILTERS]:
        both = both.where(f)
    return both.groupBy(F.col("b.doc_id").alias("a"), F.col("a.doc_id").alias("b")).agg(F.count("*").alias("shared"), F.max("a.n").alias("nb"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. A document ``a`` in many pairs is dealt out with copies of its set."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")).where("parts > 1")
    one = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).cast("int").alias("part"))
    x = sets.select(F.col("doc_id").alias("a"), F.col("values").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi").join(hot, "a", "left")
    x = x.select("a", "x", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("values").alias("y"))
    rows = dealt.join(x, ["a", "part"]).join(y, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(node, component) of the documents ``own`` (doc_id, f1) that have a link."""
    known = only(docs, own)
    often = stored(prefix_hashes(known).groupBy("hash").count().where("count > 1").select("hash"))
    ids = stored(company(known, often))
    sets = stored(sets_of(only(docs, own.join(ids, "doc_id", "left_semi"))))
    dropped(often, ids)
    shared = stored(shared_shingles(sets))
    rows = postings(shared)
    several = rows.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
    rows = stored(rows.join(several, "hash"))
    # the text that others were made from has fewest shingles of its own, so most company for its size
    rows = stored(rows.drop("c").join(rows.groupBy("doc_id").agg((F.sum("c") / F.max("n")).alias("company")), "doc_id"))

    tried, open_rows = None, rows.withColumn("comp", F.col("doc_id"))
    for first in (F.col("company"), None):
        if first is not None:  # each document against one of its shingles' centres, the one it shares most with, if that is much
            centre = open_rows.groupBy("hash").agg(F.max_by(F.struct("doc_id", "n", "alone", "pos", "comp"), F.struct(first, "doc_id")).alias("c")).select("hash", "c.*")
            pairs = candidates(open_rows, centre, ["a.comp <> b.comp"]).where("100 * shared >= nb").groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        else:  # all that is left between components
            marked = open_rows.join(signatures(shared), "doc_id")
            pairs = candidates(marked, marked, ["a.comp < b.comp", *_SUFFIX])
        pairs = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")) if first is None else pairs.select("b", "a")
        if tried is not None:
            seen = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            pairs = pairs.join(seen, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
        new = verified(stored(pairs), sets)
        tried = stored(new if tried is None else tried.unionByName(new))
        comps = stored(components(tried.where("linked")))
        if first is not None:
            joined = rows.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
            mixed = joined.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hash")
            open_rows = stored(joined.join(mixed, "hash", "left_semi"))
            if open_rows.isEmpty():
                break
    dropped(sets, shared, rows)
    return comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Links are shingle sets with 100 * intersection >= PERCENT * union; a component is named by its smallest
    doc_id. Texts without words (null, empty) have no shingles and are linked with nothing. A row without
    doc_id has no component and links nothing. Rows that share a doc_id are one document; if their texts
    differ, the one with most shingles (ties: with the greatest print) is its text, and each row has its own size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    rows = stored(summaries(docs))
    texts = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("t")).select("doc_id", "t.*")
    classes = stored(texts.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    comps = links(docs, classes.select(F.col("rep").alias("doc_id"), "f1"))
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", "copies", F.coalesce("component", "rep").alias("c"), "rep")
    # a document that is alone in its class and component names itself and need not be joined
    named = stored(named.where("copies > 1 or c <> rep").select("f1", "f2", "n", "c"))
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    moved = texts.join(named, ["f1", "f2", "n"]).select("doc_id", "c").where("c <> doc_id")
    out = rows.join(moved, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLES = {
    "op4_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as x
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
e as (select a, b from l union select b, a from l),
r as (select a as node, a as other from e union select r.node, e.b from r join e on r.other = e.a)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join (select node, min(other) as c from r group by node) m on m.node = w.doc_id"""
}
