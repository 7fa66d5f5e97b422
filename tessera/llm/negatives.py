"""Hard negatives by distributed radix selection: the first k rows of many windows, without sorting or shuffling all scores.

Rows are packed into tiles, anchors into blocks, and a tile meets every block as matrices. Nothing of a pair is
written. Instead each window, an anchor with a range of scores, first gets a histogram of the scores' leading digit: small counts,
added up by a shuffle. They tell in which bucket the kth score lies; the next pass counts the next digit inside that bucket,
and so on. Rows that share the kth score go on by the digits of their ids. When few rows besides the k are left, one
more pass gathers only these.

The first selection finds each anchor's positives (same label, any score), the second the negatives in each
positive's range of scores. Work is anchors times rows, as anyone's exact answer; memory is a tile and a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stored, table

TILE, BLOCK = 4096, 1024
#: A digit has so many bits; a window is gathered once at most ``GATHER`` times k rows qualify.
DIGIT, GATHER = 5, 4
#: Blocks up to this many bytes (counted) go to all tasks; beyond, tiles are dealt to them by shuffle, in ``SALT`` parts a block.
BROADCAST, SALT = 32 << 20, 64
HIGH = (1 << 63) - 1


def quantized(rows: DataFrame, id: Column, vector: Column, label: Column, scale: float = 256.0) -> DataFrame:
    """(id, label, v): each component is floor(scale * x). Rows with a null id, label or vector, or a null or non-finite component leave."""
    x = rows.select(id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    x = x.where(F.forall("v", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    return x.select("id", "label", F.transform("v", lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors end in zeros."""
    n = np.diff(np.asarray(v.offsets)).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def _kind(width: int, most: int) -> type:
    """The quickest numbers in which inner products are exact; beyond 2**53 longs, which wrap."""
    bound = width * most * most
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def tiles(rows: DataFrame, width: int, kind: type, size: int, name: str) -> DataFrame:
    """(name, ids, labels, m): up to ``size`` rows of a partition as bytes of longs and of a matrix; ``name`` numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                m = _matrix(part.column(2), width).astype(kind)
                one = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([at]), *[pa.array([b], pa.binary()) for b in (*one, m.tobytes())]], [name, "ids", "labels", "m"])
                at += 1

    return rows.select("id", "label", "v").mapInArrow(run, f"{name} long, ids binary, labels binary, m binary")


#: The state of a window: rows with scores in (hi, top] are in; of those in [lo, hi], and if lo = hi with ids in [ilo, ihi], ``need`` more.
STATE = ["slot", "other", "top", "lo", "hi", "ilo", "ihi", "need", "sure"]


def _bits(span: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), span, side="right")


class Meeting:
    """A tile and a block, with the block's windows."""

    def __init__(self, row: dict, windows: dict[str, np.ndarray], kind: type, width: int):
        self.block, self.w = row["block"], windows
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.own, self.own_labels = (np.frombuffer(row[c], np.int64) for c in ("block_ids", "block_labels"))
        self.scores = np.frombuffer(row["block_m"], kind).reshape(-1, width) @ np.frombuffer(row["m"], kind).reshape(-1, width).T

    def inside(self, upto: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, score) where a window looks at a row: label as asked for, another id if the labels are alike, score from lo to ``upto``."""
        w, found = self.w, []
        by = np.argsort(w["slot"], kind="stable")
        anchor = w["slot"][by] >> 32
        for j in np.unique(anchor):
            score, alike = self.scores[j].astype(np.int64), self.labels == self.own_labels[j]
            rows = [np.flatnonzero(alike & (self.ids != self.own[j])), np.flatnonzero(~alike)]
            values = [score[r] for r in rows]
            for k in by[np.searchsorted(anchor, j) : np.searchsorted(anchor, j, side="right")]:
                value = values[w["other"][k]]
                at = np.flatnonzero((value >= w["lo"][k]) & (value <= w[upto][k]))
                found.append((rows[w["other"][k]][at], np.full(len(at), k), value[at]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def histogram(self) -> pa.RecordBatch:
        """Counts of the next digit in the open part of each window: of the score, or of the id where one score is left.

        ``a`` and ``b`` are the least and the greatest score, or id, of the bucket.
        """
        w, (r, k, value) = self.w, self.inside("hi")
        by_id = w["lo"] == w["hi"]
        long = {c: w[c].astype(np.int64).view(np.uint64) for c in ("lo", "hi", "ilo", "ihi")}
        span = np.where(by_id, long["ihi"] - long["ilo"], long["hi"] - long["lo"])
        shift = np.maximum(_bits(span) - DIGIT, 0).astype(np.uint64)
        ids = self.ids[r]
        keep = np.flatnonzero(~by_id[k] | ((ids >= w["ilo"][k]) & (ids <= w["ihi"][k])))
        k, value, ids = k[keep], value[keep].view(np.uint64), ids[keep].view(np.uint64)
        digit = np.where(by_id[k], ids - long["ilo"][k], long["hi"][k] - value) >> shift[k]
        counts = np.bincount((k << DIGIT) | digit.astype(np.int64), minlength=1)
        at = np.flatnonzero(counts)
        k, bucket = at >> DIGIT, (at & ((1 << DIGIT) - 1)).astype(np.uint64)
        first = bucket << shift[k]
        last = np.minimum(first + ((np.uint64(1) << shift[k]) - np.uint64(1)), span[k])
        ends = [np.where(by_id[k], long["ilo"][k] + x, long["hi"][k] - y).view(np.int64) for x, y in ((first, last), (last, first))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), self.block, np.int64)), pa.array(w["slot"][k]), pa.array(bucket.astype(np.int32)), *map(pa.array, ends), pa.array(counts[at])], ["block", "slot", "bucket", "a", "b", "n"])

    def gather(self, most: int) -> pa.RecordBatch:
        """Rows that qualify; of a tile's rows none but its own first ``most`` can be among the first of a window."""
        w, (r, k, value) = self.w, self.inside("top")
        ids = self.ids[r]
        at = np.flatnonzero((value > w["hi"][k]) | (w["lo"] < w["hi"])[k] | (ids <= w["ihi"][k]))
        at = at[np.lexsort((ids[at], -value[at], k[at]))]
        at = at[np.arange(len(at)) - np.searchsorted(k[at], k[at]) < most]
        slot = w["slot"][k[at]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.full(len(at), self.block), slot, self.own[slot >> 32], ids[at], value[at])], ["block", "slot", "anchor_id", "id", "score"])


def meet(tiled: DataFrame, blocks: DataFrame, state: DataFrame, kind: type, width: int, what: str, schema: str, *args: int) -> DataFrame:
    """The results of ``Meeting.what`` for each tile and each block with windows in ``state``."""
    per = state.groupBy("block").agg(F.collect_list(F.struct(*STATE)).alias("windows"))
    right = stored(blocks.join(per, "block").select("block", F.col("ids").alias("block_ids"), F.col("labels").alias("block_labels"), F.col("m").alias("block_m"), "windows"))
    numbers = sorted(r[0] for r in right.select("block").collect())  # a long for each ``BLOCK`` anchors
    left = tiled.withColumn("block", F.explode(F.array(*map(F.lit, numbers)).cast("array<long>")))
    if len(numbers) * BLOCK * (np.dtype(kind).itemsize * width + 16) + state.count() * 8 * len(STATE) <= BROADCAST:
        met = left.join(F.broadcast(right), "block")
    else:
        parts = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = left.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(SALT)).cast("int")).join(parts, ["block", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "windows"}
                held = batch.column("windows").slice(i, 1).flatten()
                windows = {c: held.field(c).to_numpy(zero_copy_only=False) for c in STATE}
                yield getattr(Meeting(row, windows, kind, width), what)(*args)

    return met.select("ids", "labels", "m", "block_ids", "block_labels", "block_m", "block", "windows").mapInArrow(run, schema)


def select(tiled: DataFrame, blocks: DataFrame, windows: DataFrame, k: int, kind: type, width: int) -> DataFrame:
    """(block, slot, anchor_id, id, score, rank) of the first ``k`` rows of each window, higher scores and then smaller ids first.

    ``windows``: block, slot (place of the anchor in its block << 32, and any number), other (1: rows of another label, 0: of
    the same, but not of the anchor's id), lo, hi (scores), ilo, ihi (a range that holds all ids).
    """
    first = {"top": F.col("hi"), "need": F.lit(k).cast("long"), "sure": F.lit(0).cast("long")}
    open_, done = stored(windows.where("lo <= hi").withColumns(first).select("block", *STATE)), []
    while not open_.isEmpty():
        counts = meet(tiled, blocks, open_, kind, width, "histogram", "block long, slot long, bucket int, a long, b long, n long")
        counts = counts.groupBy("block", "slot", "bucket").agg(F.sum("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
        each = Window.partitionBy("block", "slot")
        counts = counts.withColumns({"all": F.sum("n").over(each), "upto": F.sum("n").over(each.orderBy("bucket"))})
        # the bucket in which the count reaches what is needed, or the last one
        want, by_id = F.least("need", "all"), F.col("lo") == F.col("hi")
        kth = open_.join(counts, ["block", "slot"]).where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want))
        moved = {"lo": F.when(by_id, F.col("lo")).otherwise(F.col("a")), "hi": F.when(by_id, F.col("hi")).otherwise(F.col("b")), "ilo": F.when(by_id, F.col("a")).otherwise(F.col("ilo")), "ihi": F.when(by_id, F.col("b")).otherwise(F.col("ihi"))}
        before = F.col("upto") - F.col("n")
        kth = stored(kth.withColumns(moved | {"need": F.col("need") - before, "sure": F.col("sure") + before}))
        few = (F.col("sure") + F.col("n") <= GATHER * k) | ((F.col("lo") == F.col("hi")) & (F.col("ilo") == F.col("ihi")))
        done.append(kth.where(few).select("block", *STATE))
        open_ = stored(kth.where(~few).select("block", *STATE))
    schema = "block long, slot long, anchor_id long, id long, score long"
    state = stored(reduce(DataFrame.unionByName, done)) if done else open_
    found = meet(tiled, blocks, state, kind, width, "gather", schema, k)
    rank = F.row_number().over(Window.partitionBy("block", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows`` (id, label, v of longs).

    An anchor's positives are its first ``positives`` rows of the same label and another id; a positive's negatives its first
    ``negatives`` rows of another label with low * positive_score <= 100 * score <= high * positive_score. Scores are
    inner products (as longs, which wrap), higher ones come first, and ties go to the smaller id. Rows that repeat an id all count, as
    anchors too. Vectors of fewer components end in zeros. A positive without such rows, or with a negative score, has no result.
    """
    rows = stored(rows.select("id", "label", "v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, most, norm, least, greatest, n = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.sqrt(square)), F.min("id"), F.max("id"), F.count_if(anchor)).first()
    width = max(1, width or 0)
    kind = _kind(width, int(most or 0))
    tiled = stored(tiles(rows, width, kind, TILE, "tile"))
    blocks = stored(tiles(rows.where(anchor).repartition(max(1, -(-n // BLOCK))), width, kind, BLOCK, "block"))
    norm = norm or 0.0

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(m, kind).reshape(-1, width).astype(np.float64)
                # no score is beyond the product of the norms
                bound = np.minimum(np.sqrt((m * m).sum(1)) * norm * (1 + 1e-9) + 1, 2.0**62).astype(np.int64) if kind is not np.int64 else np.full(len(m), HIGH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), block, np.int64)), pa.array(np.arange(len(m)) << 32), pa.array(bound)], ["block", "slot", "bound"])

    ids = {"ilo": F.lit(least).cast("long"), "ihi": F.lit(greatest).cast("long")}
    wide = blocks.select("block", "m").mapInArrow(ranges, "block long, slot long, bound long")
    wide = wide.withColumns({"other": F.lit(0), "lo": -F.col("bound"), "hi": F.col("bound"), **ids})
    with small_batches(rows.sparkSession, 1 << 20):
        near = select(tiled, blocks, wide, positives, kind, width)
        near = stored(near.select("block", (F.col("slot") + F.col("rank")).alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        score = F.col("positive_score")
        # of scores from 0 on, by hundreds and the rest of them so that nothing overflows; div rounds down
        part = lambda p, up: F.expr(f"{p} * (positive_score div 100) + ({p} * (positive_score % 100) + {up}) div 100")
        bounds = {"lo": part(low, 99), "hi": part(high, 0), "other": F.lit(1), **ids}
        found = select(tiled, blocks, near.where(score >= 0).withColumns(bounds), negatives, kind, width)
        found = stored(found.select("block", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    return near.join(found, ["block", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantized(e, F.col("vec_id"), F.col("embedding"), label), F.col("id") % 100 == 0)


ORACLES = {
    "op11_hard_negatives": """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
}
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
