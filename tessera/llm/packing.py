"""Harmonic packing of tokenized documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than capacity // (k + 1) and at
most capacity // k tokens long, and each of its sequences takes exactly k pieces. A document is first cut
into whole sequences; what is left is cut down to the largest class limit it reaches, again and again, so
that every piece of ``LEAST`` tokens or more fills its share exactly. Each partition fills its classes on
its own and needs no other; when it ends, the few pieces in unfilled sequences are packed first-fit by
falling length. Memory is bounded by the classes, whatever the number of documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

CAPACITY = 1024
#: A rest of fewer tokens is not cut any more.
LEAST = 64
END = 0
#: How the byte-level vocabulary splits text before merging (a fixed value of that tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def encoder(path: str):
    """Gives a text's ids under the tokenizers JSON file, as the tokenizers library does.

    A text with the string of an added token goes through that library. All others, which only the byte-level
    merges concern, go through tiktoken with the same vocabulary: the same ids (tested) in a quarter of the CPU time.
    """
    import tiktoken

    # the vocabulary writes byte b as a printable code point: itself if printable, else 256, 257, ... in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = [x["content"] for x in model.get("added_tokens", [])]
    ranks = {bytes(byte[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in added}
    merges = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return lambda text: library().encode(text, add_special_tokens=False).ids if any(x in text for x in added) else merges(text)


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= LEAST:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


class Bins:
    """The open sequences of one partition. A piece is (length, whatever belongs to it)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.open = capacity, first_id, {}

    def close(self, pieces: list) -> list:
        out, at = [], 0
        for length, piece in pieces:
            out.append((self.next, at, length, piece))
            at += length
        self.next += 1
        return out

    def add(self, length: int, piece) -> list:
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((length, piece))
        return self.close(self.open.pop(k)) if len(held) == k else []

    def rest(self) -> list:
        bins: list[list] = []
        room: list[int] = []
        for length, piece in sorted((x for held in self.open.values() for x in held), key=lambda x: -x[0]):
            at = next((i for i, r in enumerate(room) if r >= length), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[at].append((length, piece))
            room[at] -= length
        self.open = {}
        return [x for b in bins for x in self.close(b)]


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: the columns of ``docs`` but the text, then ``SCHEMA``.

    ``ids`` holds little-endian unsigned 32-bit ids; a document's ids end with ``end``. A null or empty
    text is that one id. Columns of ``docs`` named as in ``SCHEMA`` are left out. Every row is packed by itself:
    rows that repeat a doc_id, or have none, give their pieces as often as they stand there.
    """
    own = {x.split()[0] for x in SCHEMA.split(", ")}
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in own]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, encode = Bins(capacity, TaskContext.get().partitionId() << 40), encoder(tokenizer)
        held: list = []

        def out(rows: list) -> pa.RecordBatch:
            seq, at, length, piece = zip(*rows, strict=True)
            cols = [pa.array([p[0][j] for p in piece], t) for j, t in enumerate(types)]
            cols += [pa.array([p[1] for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array([p[2] for p in piece], pa.binary()), pa.array([p[3] for p in piece], pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=[*names, *(x.split()[0] for x in SCHEMA.split(", "))])

        types: list = []
        for batch in batches:
            types = [batch.schema.field(j + 1).type for j in range(len(names))]
            others = zip(*(batch.column(j + 1).to_pylist() for j in range(len(names))), strict=True) if names else iter([()] * batch.num_rows)
            for text, row in zip(batch.column(0), others, strict=True):
                found = encode(text.as_py() or "")
                found.append(end)
                ids = np.array(found, "<u4").tobytes()
                n, at = len(found), 0
                for length in cuts(n, capacity):
                    held += bins.add(length, (row, at, ids[4 * at : 4 * (at + length)], n))
                    at += length
                if len(held) >= 4096:
                    yield out(held)
                    held = []
        held += bins.rest()
        if held:
            yield out(held)

    return docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op9_packing": op9_packing}
