"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded as a fixed vector (shares of
character kinds, word shapes, repetition, hashed words). A hidden layer embeds it, gated attention weighs
it against the bag's other passages, and the weighted sum is scored; all of it is learned from document
labels alone, by full-batch Adam on the driver over a sample of at most SAMPLE labelled documents.
Encoding and scoring run on the executors, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytescan
from tessera.llm.common import table

PASSAGE = 64
#: Buckets of hashed words, after the shares.
HASHED = 96
#: Labelled documents to learn from, half of each class as far as there are; the first by a hash of doc_id.
SAMPLE = 6000
HIDDEN, GATE, ROUNDS, RATE, DECAY = 24, 12, 250, 0.02, 1e-4
PREDICT_AT = 0.7
U = np.uint64
_GROUPS = ["A-Z", "a-z", "0-9", "#*$%&<>", "|", "!", ".?", ",;:", "'\"()", "\n", "high", "mark"]


def _kinds() -> np.ndarray:
    kind = np.full(256, -1, np.int8)
    for j, g in enumerate(_GROUPS):
        if g == "high":
            kind[192:] = j
        elif g == "mark":
            kind[128:192] = j
        elif len(g) == 3 and g[1] == "-":
            kind[ord(g[0]) : ord(g[2]) + 1] = j
        else:
            kind[[ord(c) for c in g]] = j
    return kind


KIND = _kinds()
WIDTH = len(_GROUPS) + 8 + HASHED


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of all passages, index of each text's first passage and one past the last). A text without words is one passage of zeros."""
    starts, ends, at = bytescan.words(data, offsets)
    h = bytescan.span_hash(bytescan.sums(bytescan.LOWER[data]), starts, ends)
    n = np.diff(at)
    bags = np.maximum(-(-n // PASSAGE), 1)
    index = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((index[-1], WIDTH), np.float32)
    if not len(starts):
        return out, index
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(starts)) - at[text]
    passage = index[text] + within // PASSAGE
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    rows = passage[first]
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], ends[last]
    words = (last - first + 1).astype(np.float32)
    size = (end - begin).astype(np.float32)
    for j in range(len(_GROUPS)):
        c = np.concatenate([[0], np.cumsum(KIND[data] == j)])
        out[rows, j] = (c[end] - c[begin]) / size
    length = (ends - starts).astype(np.float32)
    total = np.add.reduceat(length, first)
    square = np.add.reduceat(length * length, first)
    k = len(_GROUPS)
    out[rows, k] = total / words / 10
    out[rows, k + 1] = np.sqrt(np.maximum(square / words - (total / words) ** 2, 0)) / 10
    # words seen before: in the passage, and in the text
    order = np.lexsort((np.arange(len(h)), h, text))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(len(h), np.float32)
    again[order] = same
    near = np.zeros(len(h), np.float32)
    near[order[1:]] = same[1:] & (passage[order][1:] == passage[order][:-1])
    out[rows, k + 2] = np.add.reduceat(near, first) / words
    out[rows, k + 3] = np.add.reduceat(again, first) / words / np.maximum(np.log2(2 + index[text[first] + 1] - index[text[first]]), 1)
    capital = ((data[starts] >= 65) & (data[starts] <= 90)).astype(np.float32)
    out[rows, k + 4] = np.add.reduceat(capital, first) / words
    tail = data[ends - 1]
    stop = np.isin(tail, [46, 33, 63]).astype(np.float32)
    out[rows, k + 5] = np.add.reduceat(stop, first) / words
    out[rows, k + 6] = np.minimum(words / PASSAGE, 1)
    out[rows, k + 7] = np.add.reduceat((length <= 2).astype(np.float32), first) / words
    bucket = (h % U(HASHED)).astype(np.int64)
    counts = np.bincount(passage * HASHED + bucket, minlength=index[-1] * HASHED).reshape(-1, HASHED).astype(np.float32)
    out[:, k + 8 :] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out, index


def _softmax(s: np.ndarray, index: np.ndarray) -> np.ndarray:
    n = np.diff(index)
    top = np.maximum.reduceat(s, index[:-1])
    e = np.exp(s - np.repeat(top, n))
    return e / np.repeat(np.add.reduceat(e, index[:-1]), n)


def score(m: dict[str, np.ndarray], x: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of label 1 by bag, attention by passage)."""
    x = (x - m["mean"]) * m["scale"]
    h = np.tanh(x @ m["W"] + m["b"])
    a = _softmax((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["Q"])))) @ m["w"], index)
    z = np.add.reduceat(a[:, None] * h, index[:-1])
    return 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30))), a


def fit(x: np.ndarray, index: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from bags and their labels; both classes count as much in all."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    mean, dev = x.mean(0), x.std(0)
    scale = np.where(dev > 1e-6, 1 / np.maximum(dev, 1e-6), 0).astype(np.float32)
    fixed = {"mean": mean, "scale": scale}
    x = np.clip((x - mean) * scale, -8, 8)
    draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "Q": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros((), np.float32)}
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(np.float32)
    n = np.diff(index)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p["W"] + p["b"])
        tv, sq = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["Q"])))
        a = _softmax((tv * sq) @ p["w"], index)
        z = np.add.reduceat(a[:, None] * h, index[:-1])
        out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        g = (out - y) * weight
        dz = np.repeat(g, n)[:, None] * p["c"]
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, index[:-1]), n))
        dgate = ds[:, None] * p["w"]
        dv, dq = dgate * sq * (1 - tv**2), dgate * tv * sq * (1 - sq)
        dh = a[:, None] * dz + dv @ p["V"].T + dq @ p["Q"].T
        du = dh * (1 - h**2)
        grad = {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dv, "Q": h.T @ dq, "w": (tv * sq).T @ ds, "c": z.T @ g, "d": g.sum()}
        for k in p:
            d = grad[k] + DECAY * p[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            p[k] = (p[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return fixed | p


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def encoded_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages, index, labels) of at most ``sample`` labelled documents that are not held out, with all their passages.

    Labels that say the same twice count once; a document labelled both ways is not learnt from.
    """
    own = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    half = [own.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
    ids = half[0].unionByName(half[1])  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offsets in bytescan.blocks(b.column(2)):
                x, index = encode(data, offsets)
                rows = [x[s:e].astype(np.float16).tobytes() for s, e in zip(index[:-1], index[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    bags = [np.frombuffer(v.as_buffer(), np.float16).reshape(-1, WIDTH) for v in got.column("x")]
    index = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return (np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float16)), index, got.column("quality").to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    x, index, y = encoded_sample(docs, labels, sample)
    return fit(x, index, y) if len(y) else None


def classify(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """Columns of ``docs`` but the text, with score, n_passages and top_passage (the one of most attention, from 0).

    Null and empty texts are one empty passage; every row is scored by its whole text, whatever its doc_id. Without a model (no labelled rows) every score is 0.5.
    """
    names = [c for c in docs.columns if c not in ("text", "score", "n_passages", "top_passage")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "score double, n_passages long, top_passage long"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at, n, data, offsets in bytescan.blocks(b.column(0)):
                x, index = encode(data, offsets)
                p, a = score(m, x, index) if m else (np.full(n, 0.5), np.zeros(len(x)))
                size = np.diff(index)
                best = np.maximum.reduceat(a, index[:-1])
                hit = np.flatnonzero(a == np.repeat(best, size))
                owner = np.repeat(np.arange(n), size)[hit]
                top = hit[np.unique(owner, return_index=True)[1]] - index[:-1]
                others = [c.slice(at, n) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([*others, pa.array(p.astype(np.float64)), pa.array(size.astype(np.int64)), pa.array(top.astype(np.int64))], names=[*names, "score", "n_passages", "top_passage"])

    return docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = classify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "n_passages", "top_passage")


QUERIES = {"op1_quality_mil": op1_quality_mil}
