"""Line dedup with a tree of line templates of fixed depth.

A line goes down the tree by its number of tokens and its first LEAD tokens, tokens with a digit being the
wildcard. A leaf holds the lines that agree so far. Below, a token that stands at its place in few of the leaf's
documents is a variable field: a line's templates are the line with its rare tokens as wildcards, for each LEVEL of
rareness, as long as at most half of the tokens behind the leading ones, digits among them, vary. So any number of
fields, wherever they stand behind the lead, is generalised, without comparing lines with each other.
A line of fewer than MIN_TOKENS tokens has one template, the whole line with its digits.
A template recurs if it stands in MIN_DOCS documents or more that differ. Documents with the same other lines
are one, and so are near copies: of the OTHERS least other lines of a document (none of the line's own leaf),
each is shared by so many documents with the template, and the line itself by all; those that fewest share,
SPREAD of all by tokens, say how many documents this one is one of. A group of copies thus counts about once, whatever other documents
hold the line, and the lines of an often copied text stay. Lines with a recurring template are dropped.

All counts are aggregates with a map-side part; leaves that cannot recur are left out before templates are
made, since a template is no more frequent than its leaf, and a line that is there often is looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytescan
from tessera.llm.common import bitmap, dropped, in_bitmap, small_batches, stored, table

MIN_TOKENS = 4
LEAD = 3
MIN_DOCS = 8
#: A token is constant if MIN_DOCS documents and this part of its leaf's have it at its place.
LEVELS = (0.0, 0.0625, 0.25, 0.5)
#: Least part of a document's lines, by tokens, that its copies do not have.
SPREAD = 0.25
#: Other lines of a document that stand for it, at most.
OTHERS = 8
#: A line stands for itself by the least hash of so many consecutive tokens, which a changed word seldom touches.
RUN = 4
#: Bytes that are broadcast at most; beyond, rows are joined by shuffle.
BROADCAST_BYTES = 16 << 20
U = np.uint64
I64 = pa.int64()
_ROOT = U(0x9E3779B97F4A7C15)


def _fold(values: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(values[0]), U(salt))
    for v in values:
        out = bytescan.mix(out * _ROOT + v)
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, line from 0, leaf, places, others, tokens) of all lines with a token.

    ``places`` is (values, how many by line): the tokens behind the leading ones, as hashes of leaf, place and token.
    ``others`` likewise: what stands for the text's other leaves, at most OTHERS.
    """
    starts, ends, at = bytescan.words(data, offsets)
    low = bytescan.LOWER[data]
    h = bytescan.span_hash(bytescan.sums(low), starts, ends)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    exact = h.copy()
    h[digits[ends] > digits[starts]] = U(1)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, starts) if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(h)))
    text = text_of[first]
    line = line_of[first] - np.searchsorted(breaks, offsets[:-1])[text]
    # a position-weighted running sum gives the hash of any run of tokens
    power = np.cumprod(np.concatenate([[U(1)], np.full(len(h), _ROOT)]))
    back = np.cumprod(np.concatenate([[U(1)], np.full(len(h), U(pow(int(_ROOT), -1, 1 << 64)))]))
    c = np.concatenate([[U(0)], np.cumsum(h * power[:-1])])
    run = lambda a, b: bytescan.mix((c[b] - c[a]) * back[a])
    i = np.arange(len(h))
    end = np.repeat(first + n, n)
    least = np.where((i + RUN <= end) | (i == np.repeat(first, n)), run(i, np.minimum(i + RUN, end)), ~U(0))
    least = np.minimum.reduceat(least, first) if len(first) else least
    lead = np.minimum(LEAD, n)
    leaf = _fold([run(first, first + lead), n.astype(U)], 1)
    short = n < MIN_TOKENS
    if len(first):
        whole = _fold([np.where(k < n, exact[np.minimum(first + k, len(h) - 1)], U(0)) for k in range(MIN_TOKENS - 1)], 7)
        leaf = np.where(short, whole, leaf)
    # a token's place in its leaf; 0 marks a token with a digit, which always varies
    place = np.where(h == U(1), U(0), _fold([np.repeat(leaf, n), (i - np.repeat(first, n)).astype(U), h], 2))
    behind = np.maximum(n - lead, 0)
    behind[short] = 0
    take = (i - np.repeat(first, n) >= LEAD) & ~np.repeat(short, n)
    return text, line, leaf, (place[take], behind), others(text, leaf, least, n, len(offsets) - 1), n


def others(text: np.ndarray, leaf: np.ndarray, least: np.ndarray, n: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the OTHERS least lines of its text, one of a leaf, none of its own leaf.

    Long lines come first more often. A value is a hash with the number of tokens in its lowest 16 bits.
    """
    order = np.lexsort((least, leaf, text))
    new = np.ones(len(order), bool)
    new[1:] = (leaf[order][1:] != leaf[order][:-1]) | (text[order][1:] != text[order][:-1])
    one = order[new]
    one = one[np.lexsort((least[one], text[one]))]
    count = np.bincount(text[one], minlength=texts)
    at = np.arange(len(one)) - (np.cumsum(count) - count)[text[one]]
    one, at = one[at <= OTHERS], at[at <= OTHERS]
    value, of = np.zeros((texts, OTHERS + 1), U), np.zeros((texts, OTHERS + 1), U)
    value[text[one], at] = (bytescan.mix(least[one]) & ~U(0xFFFF)) | np.minimum(n[one], 0xFFFF).astype(U)
    of[text[one], at] = leaf[one]
    size = np.minimum(count[text] - 1, OTHERS)
    own = (of[text] == leaf[:, None]) & (np.arange(OTHERS + 1) < count[text][:, None])
    own[:, OTHERS] |= ~own.any(axis=1)
    left = value[text][~(own & (np.cumsum(own, axis=1) == 1))].reshape(len(text), OTHERS)
    return left[np.arange(OTHERS) < size[:, None]], size


def _wide(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), I64)


def _kinds(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each line's others."""
    to = np.cumsum(size)
    total = np.concatenate([[U(0)], np.cumsum(bytescan.mix(value + (np.arange(len(value)) - np.repeat(to - size, size)).astype(U)))])
    return bytescan.mix(total[to] - total[to - size])


def leaves(docs: DataFrame) -> DataFrame:
    """(leaf, kind): once for each leaf of a text; ``kind`` is a hash of its other lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in bytescan.blocks(b.column(0)):
                text, _, leaf, _, rest, _ = lines(data, offsets)
                kind = _kinds(*rest)
                order = np.lexsort((leaf, text))
                text, leaf = text[order], leaf[order]
                new = np.ones(len(leaf), bool)
                new[1:] = (leaf[1:] != leaf[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([_wide(leaf[new]), _wide(kind[order][new])], names=["leaf", "kind"])

    return docs.select("text").mapInArrow(run, "leaf long, kind long")


def in_leaves(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, mark, line, leaf, places, kind, others, tokens) of every line in a ``frequent`` (leaf); ``mark`` is a hash of the text."""
    nested = lambda size, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), _wide(values))
    held = docs.sparkSession.sparkContext.broadcast(bitmap(frequent, "leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offsets in bytescan.blocks(b.column(2)):
                text, line, leaf, (place, behind), rest, n_tokens = lines(data, offsets)
                keep = in_bitmap(held.value, leaf)
                rows = pa.array(text[keep])
                arrays = [nested(size[keep], values[np.repeat(keep, size)]) for values, size in ((place, behind), rest)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n).take(rows), b.column(1).slice(at, n).take(rows), _wide(line[keep]), _wide(leaf[keep]), arrays[0], _wide(_kinds(*rest)[keep]), arrays[1], _wide(n_tokens[keep])],
                    names=["doc_id", "mark", "line", "leaf", "places", "kind", "others", "tokens"],
                )

    kept = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, mark long, line long, leaf long, places array<bigint>, kind long, others array<bigint>, tokens long"
    return kept.mapInArrow(run, schema).join(small(frequent), "leaf", "left_semi")


def templates(rows: DataFrame) -> DataFrame:
    """(whole, key) for every kind of line in ``rows`` (whole, leaf, places, kind): the keys of its templates."""
    types = rows.groupBy("whole", "kind").agg(F.first("leaf").alias("leaf"), F.first("places").alias("places"))
    types = stored(types.groupBy("whole").agg(F.first("leaf").alias("leaf"), F.first("places").alias("places"), F.count("*").alias("k")))
    counts = types.select(F.explode("places").alias("p"), "k").where("p <> 0").groupBy("p").agg(F.sum("k").alias("c")).where(F.col("c") >= MIN_DOCS)
    each = types.select("whole", "leaf", F.posexplode_outer("places").alias("at", "p")).join(counts, "p", "left")
    x = F.sort_array(F.collect_list(F.struct("at", "p", F.coalesce("c", F.lit(0)).alias("c")))).alias("x")
    laid = each.groupBy("whole", "leaf").agg(x).join(types.groupBy("leaf").agg(F.sum("k").alias("total")), "leaf")
    keys = []
    for level in LEVELS:
        least = F.greatest(F.lit(MIN_DOCS), F.lit(level) * F.col("total"))
        kept = F.transform("x", lambda t: F.when(t["c"] >= least, t["p"]).otherwise(F.lit(0).cast("bigint")))  # noqa: B023
        varies = F.size(F.filter(kept, lambda t: t == 0))
        short = F.get("x", F.lit(0))["at"].isNull()
        keys.append(F.when(short, F.col("leaf")).when(2 * varies <= F.size("x"), F.xxhash64("leaf", kept)))
    return laid.select("whole", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))


def recurring(rows: DataFrame) -> DataFrame:
    """The keys of rows (key, others, tokens of the line) that recur."""
    rows = rows.distinct()
    often = stored(rows.groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") >= MIN_DOCS))
    rows = stored(rows.join(small(often), "key"))
    low = F.col("x").bitwiseAND(0xFFFF)
    weight = F.coalesce(low, F.lit(0).cast("bigint"))
    each = rows.withColumn("x", F.explode_outer("others")).withColumns({"w": weight, "x": F.col("x") - low})
    shared = stored(each.groupBy("key", "x").agg(F.count("*").alias("n")).where("n > 1"))
    met = each.join(small(shared), ["key", "x"], "left").select("key", "others", "tokens", "all", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "w").alias("s"))
    by_doc = met.groupBy("key", "others", "tokens", "all").agg(F.sort_array(F.collect_list("s")).alias("s"))
    s = F.array_append("s", F.struct(F.col("all").alias("n"), F.col("tokens").alias("w")))
    total = F.aggregate("s", F.col("tokens"), lambda t, x: t + x["w"])
    # the first n at which the sum of tokens reaches the part
    state = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct((a["t"] + x["w"]).alias("t"), F.when(a["t"] < SPREAD * total, x["n"]).otherwise(a["n"]).alias("n"))
    counted = by_doc.select("key", F.aggregate(s, state, step)["n"].alias("n"))
    return counted.groupBy("key").agg(F.round(F.sum(1 / F.col("n")), 6).alias("docs")).where(F.col("docs") >= MIN_DOCS).select("key")


def small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if their counted size allows it; arrays count with their items."""
    wide = [F.size(f.name) for f in rows.schema.fields if f.dataType.typeName() == "array"]
    size = F.lit(8 * len(rows.columns)) + 8 * sum(wide, F.lit(0))
    found = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(rows) if found <= BROADCAST_BYTES else rows


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, lines): the numbers, from 0, of the lines to drop, for documents that have any."""
    found = leaves(docs).groupBy("leaf", "kind").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("kinds"))
    frequent = stored(found.where(F.col("kinds") >= MIN_DOCS).select("leaf"))
    rows = stored(in_leaves(docs, frequent).withColumn("whole", F.xxhash64("leaf", "places")))
    keys = stored(templates(rows))
    keyed = stored(rows.select("doc_id", "mark", "line", "others", "tokens", "whole").join(small(keys), "whole").drop("whole"))
    again = stored(recurring(keyed.select("others", "tokens", "key")))
    hit = keyed.select("doc_id", "mark", "line", "key").join(small(again), "key", "left_semi")
    out = stored(hit.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines")))
    dropped(frequent, rows, keys, keyed, again)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` added.

    Needs columns doc_id and text; the result keeps all rows and all columns but those two names. Null and empty texts
    stay as they are; a text of which every line is dropped becomes empty. Rows without doc_id take part like others,
    and rows that repeat a text, with its doc_id or another, are treated alike and count as one document.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        drops = dropped_lines(own)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = F.col("row.text").cast("string")
    joined = d.join(small(drops), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("mark")), "left")
    parts = F.split(text, "\n")
    left = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(parts, lambda p, i: ~F.array_contains("lines", i.cast("long"))), "\n"))
    n = F.when(F.length(text) > 0, F.size(parts)).otherwise(0).cast("long")
    return joined.select(*[left.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in names], n.alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {"op5_line_dedup": op5_line_dedup}
