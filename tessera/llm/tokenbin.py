"""Token ids of a corpus as compressed binary files: written in ascending doc_id order, read back whole or by file.

A file is a run of blocks. A block holds up to ``idcoder.BLOCK`` consecutive ids, coded from an empty model, and the
documents that begin in it, so that it can be checked and read alone. All numbers are little-endian:

| bytes | field |
|-|-|
| 4 | ``TIDB`` |
| 4 | 0, or 1 if ids take 32 bits |
| 4, 8 | number of the file (files in ascending order hold ascending doc_ids), place of the block's first id in the file |
| 4, 4, 4 | documents that begin here, ids, bytes of the payload |
| 4, 4 | crc32 of the ids as unsigned 32-bit integers; crc32 of all header fields before it, the document rows and the payload |
| 17 each | documents: 1 byte (1: no doc_id), doc_id, number of ids |
| rest | payload |

A line feed, which Spark's text writer adds, follows each block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import idcoder
from tessera.llm.bytescan import LOWER
from tessera.llm.common import shared_dir, small_batches, table

END = 2
#: Bytes of text that a file is made of, more or less. Ranges of doc_id that hold more go to more tasks.
FILE_BYTES = 8 << 20
#: Bytes of files that are decoded together, more or less: small files are, one of ``FILE_BYTES`` of text is read alone.
TOGETHER = 2 << 20
#: A small file has blocks of fewer ids, so that it is still coded many at a time; blocks have so many ids at least.
LEAST_BLOCK, LEAST_LANES = 1024, 512
#: Words whose ids a worker remembers at most, bits of the table in which words of at most ``SHORT`` bytes are found, and places that a word may have.
WORDS, TABLE_BITS, SHORT, WAYS = 1 << 19, 20, 15, 4
LEADING = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
HEADER = struct.Struct("<4sIIQIIII")
ROW = np.dtype([("none", "u1"), ("doc_id", "<i8"), ("n", "<u8")])


#: Bits of bytes: 1 for a letter, 2 for punctuation that ends a word, 4 for a capital.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[range(65, 91)] |= 4
CLASS[[ord(c) for c in ".,;:!?"]] = 2
#: Small letters for capitals, a space for a line feed.
SMALL = LOWER.copy()
SMALL[10] = 32
#: A text on which words, and words and punctuation, must have the same ids apart as together.
PROBE = "Word another, word. AND, more: words; yes! no? O'Neil isn't 42nd straße señor àéîõü ªº ŵſŉ (it's) 'tis a1b22 x_y-z'll ''s 12,345.6 <b>&%%% we've"
#: Behind the last of the letters that ``words`` encodes by the merges alone, and how it cuts printable ASCII.
LATIN_END = "\u0250"
PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")


def merges(path: str) -> tuple[Callable[[str], list[int]] | None, np.ndarray]:
    """Gives the ids of pieces that each end with a zero character, by tiktoken over the vocabulary of the tokenizers JSON file; and by id whether it ends a piece.

    The zero stands for ``</w>`` (so pieces hold none): the same ids as the tokenizers library's (tested) in a tenth of the CPU time.
    Without ``</w>`` in the vocabulary there are no such merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # the vocabulary writes byte b as a printable code point: itself if printable, else 256, 257, ... in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    ranks, ends = {}, np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for piece, i in vocabulary.items():
        body, end, _ = piece.partition("</w>")
        ends[i] = bool(end)
        if all(c in byte for c in body):
            word = bytes(byte[c] for c in body)
            if 0 not in word or word == b"\0" and not end:
                ranks[word + b"\0" * bool(end)] = i
    if not ends.any():
        return None, ends
    return tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, ends


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (and zeros behind them) with capitals before ASCII in lower case, where words begin and end in them, and words of each text.

    Words lie between spaces and line feeds; punctuation behind a letter begins another word.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(data)
    small = np.zeros((n // 8 + 4) * 8, np.uint8)
    SMALL.take(data, out=small[:n], mode="clip")
    kind = CLASS.take(data, mode="clip")
    mixed = np.flatnonzero((data[1:] >= 128) & (kind[:-1] >= 4))
    small[mixed] = data[mixed]
    border = np.zeros(n + 1, bool)
    border[1:n] = kind[:-1] & (kind[1:] >> 1) & 1
    border[offsets] = True
    space = np.ones(n + 2, bool)
    np.equal(small[:n], 32, out=space[1:-1])
    begin = np.flatnonzero((border[:-1] | space[:-2]) & ~space[1:-1])
    end = np.flatnonzero((border[1:] | space[2:]) & ~space[1:-1]) + 1
    return small, begin, end, np.diff(np.searchsorted(begin, offsets))


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Pieces of ``data``, which follow one another, as strings."""
    bounds = np.stack([begin, end], 1).ravel()
    both = pa.LargeStringArray.from_buffers(max(0, len(bounds) - 1), pa.py_buffer(np.append(bounds, 0)), pa.py_buffer(data))
    return both.take(pa.array(np.arange(0, len(both), 2)))


def keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the length of words of at most ``SHORT`` bytes as two integers."""
    whole, at, shift = data.view("<u8"), begin >> 3, (begin & 7).astype(np.uint64) << np.uint64(3)
    parts = [whole.take(at + i, mode="clip") for i in range(3)]
    # a shift by 64 gives 0
    first, second = (a >> shift | b << (np.uint64(64) - shift) for a, b in zip(parts, parts[1:], strict=False))
    return first & LEADING.take(size, mode="clip"), second & LEADING.take(size - 8, mode="clip") | size.astype(np.uint64) << np.uint64(56)


class Tokenizer:
    """Ids of a batch of texts, equal to the tokenizers library's, for a tokenizer that lowers case and drops white space.

    Such a tokenizer never looks across a space, nor from a letter to punctuation, so each different word is encoded once.
    Texts that may hold an added token go through the library whole; so do all texts for another tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = sorted({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        self.merges, self.ends = merges(path)
        apart = [i for w in strings(*cut(pa.array([PROBE]))[:3]).to_pylist() for i in self.words([w])[2].tolist()]
        self.by_word = not self.encode([" \n "])[0].ids and self.encode([PROBE])[0].ids == apart
        self.forget()

    def forget(self) -> None:
        """No words are remembered: neither those of the table, as keys and number, nor others, which are long or whose place is taken."""
        self.first, self.second, self.number = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.others: dict[str, int] = {}
        self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the words, and in this order the number of their ids and the ids.

        Small Latin letters and printable ASCII, which no normalization concerns, are cut into pieces here and need the merges alone.
        """
        order, rest, pieces, count = [], [], [], []
        for i, w in enumerate(words):
            if self.merges and w == w.lower() and w.isalpha() and max(w) < LATIN_END:
                order.append(i)
                pieces.append(w)
                count.append(1)
            elif self.merges and w == w.lower() and w.isascii() and w.isprintable() and " " not in w:
                found = PIECES.findall(w)
                order.append(i)
                pieces += found
                count.append(len(found))
            else:
                rest.append(i)
        flat = np.array(self.merges("\0".join([*pieces, ""])) if pieces else [], np.uint32)
        last = np.flatnonzero(self.ends.take(flat))  # the last id of each piece
        size = np.diff(last[np.cumsum(np.array(count, np.int64)) - 1], prepend=-1)
        for at in range(0, len(rest), 4096):  # an encoding takes a kilobyte, so few at a time
            found = [e.ids for e in self.encode([words[i] for i in rest[at : at + 4096]])]
            size = np.append(size, np.array([len(f) for f in found], np.int64))
            flat = np.append(flat, np.fromiter(chain.from_iterable(found), np.uint32))
        return np.array(order + rest, np.int64), size.astype(np.int32), flat

    def encode(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word. Most words are met in the table; the others are encoded, each different one once."""
        size = end - begin
        first, second = keys(data, begin, size)
        place = ((first ^ second * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        short = size <= SHORT
        out = self.number.take(place).astype(np.int64)
        rest = np.flatnonzero(~((self.first.take(place) == first) & (self.second.take(place) == second) & short))
        for way in range(1, WAYS):
            to = place.take(rest) ^ way
            met = (self.first.take(to) == first.take(rest)) & (self.second.take(to) == second.take(rest)) & short.take(rest)
            out[rest[met]] = self.number.take(to[met])
            rest = rest[~met]
        if not len(rest):
            return out
        coded = strings(data, begin[rest], end[rest]).dictionary_encode()
        values, indices = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        found = np.array([self.others.get(w, -1) for w in values])
        new = np.flatnonzero(found < 0)
        if len(new):
            order, sizes, ids = self.words([values[i] for i in new])
            found[new[order]] = len(self.size) + np.arange(len(new))
            self.size, self.flat = np.append(self.size, sizes), np.append(self.flat, ids)
            where = np.zeros(len(values), np.int64)
            where[indices] = rest
            left = new[short[where[new]]]
            for way in range(WAYS):
                at = where[left]
                to = place[at] ^ way
                free = self.second[to] == 0
                to, at, number = to[free], at[free], found[left[free]]
                self.first[to], self.second[to], self.number[to] = first[at], second[at], number
                free[free] = self.number[to] == number  # of those for one place, one
                left = left[~free]
            self.others.update((values[i], int(found[i])) for i in [*left.tolist(), *new[~short[where[new]]].tolist()])
        out[rest] = found[indices]
        return out

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after those of each text, and how many each text has. Null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word or not len(texts):
            found = [np.array([*e.ids, end], np.uint32) for e in self.encode(texts.to_pylist())]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)
        special = np.zeros(len(texts), bool)
        for mark in self.marks:
            special |= np.asarray(pc.match_substring(texts, mark))
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        data, begin, stop, per_text = cut(plain)
        if len(self.size) > WORDS:
            self.forget()
        index = self.numbers(data, begin, stop)
        # words in order, and one more word of the id ``end`` behind those of each text
        size, flat = np.append(self.size, 1), np.append(self.flat, np.uint32(end))
        first = np.cumsum(size, dtype=np.int64) - size
        code, own = np.full(len(index) + len(texts), len(self.size)), np.ones(len(index) + len(texts), bool)
        own[np.cumsum(per_text + 1) - 1] = False
        code[own] = index
        n = size[code]
        ends = np.cumsum(n)
        out = flat[np.arange(ends[-1]) + np.repeat(first[code] - ends + n, n)]
        count = np.diff(ends[np.cumsum(per_text + 1) - 1], prepend=0)
        if special.any():
            cuts = np.split(out, np.cumsum(count)[:-1])
            at = np.flatnonzero(special)
            for i, e in zip(at, self.encode(texts.take(pa.array(at)).to_pylist()), strict=True):
                cuts[i] = np.array([*e.ids, end], np.uint32)
                count[i] = len(cuts[i])
            out = np.concatenate(cuts)
        return out, count


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a worker, which has one core and starts no threads for it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(path)


def blocks(file: int, place: int, doc_id: np.ndarray, none: np.ndarray, count: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """The blocks of consecutive documents; ``place`` is their first id's in the file."""
    size = min(idcoder.BLOCK, max(LEAST_BLOCK, -(-len(ids) // LEAST_LANES)))
    rows = np.zeros(len(count), ROW)
    rows["none"], rows["doc_id"], rows["n"] = none, np.where(none, 0, doc_id), count
    begin = np.cumsum(count) - count
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    for at in range(0, len(ids), size * idcoder.LANES):
        parts = [ids[i : i + size] for i in range(at, min(len(ids), at + size * idcoder.LANES), size)]
        coded = idcoder.encode(parts, wide)
        for j, (part, payload) in enumerate(zip(parts, coded, strict=True)):
            first = at + j * size
            own = rows[np.searchsorted(begin, first) : np.searchsorted(begin, first + len(part))]
            head = HEADER.pack(b"TIDB", wide, file, place + first, len(own), len(part), len(payload), zlib.crc32(part.astype("<u4")))
            body = own.tobytes() + payload
            yield head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Writes the ids of all rows of ``docs`` (doc_id, text) to files below ``path``, in ascending doc_id order.

    A null text is empty, so its document is the id ``end`` alone. Rows without doc_id come first; rows that repeat a
    doc_id all stay, in the order of a hash of their texts. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, encoder, held, place = TaskContext.get().partitionId(), tokenizer(vocabulary), [], 0
        most = 2 * idcoder.LANES * idcoder.BLOCK

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal place
            doc_id, none, count, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for block in blocks(file, place, doc_id, none, count, ids):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])
            place += len(ids)

        for batch in batches:
            if batch.num_rows:
                key = batch.column(0)
                ids, count = encoder.ids(batch.column(2), end)
                held.append((pc.fill_null(key, 0).to_numpy(zero_copy_only=False), pc.is_null(key).to_numpy(zero_copy_only=False), count, ids))
                if sum(len(h[3]) for h in held) >= most:
                    yield from flush()
        if held:
            yield from flush()
        pa.default_memory_pool().release_unused()

    sort = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    with small_batches(docs.sparkSession, 2 << 20):
        # Spark's text writer passes bytes on as they are, to any file system and by its commit protocol
        sort.mapInArrow(run, "block binary").select(F.col("block").cast("string")).write.option("compression", "none").text(path)


def parse(content: memoryview) -> Iterator[tuple[tuple, np.ndarray, bytes]]:
    """(header, document rows, payload) of the blocks of a file; a block that is damaged or cut raises ValueError."""
    at = 0
    while at < len(content):
        try:
            head = HEADER.unpack_from(content, at)
            (check,) = struct.unpack_from("<I", content, at + HEADER.size)
        except struct.error:
            raise ValueError(f"a block is cut at byte {at}") from None
        body = at + HEADER.size + 4
        stop = body + head[4] * ROW.itemsize + head[6]
        if head[0] != b"TIDB" or stop >= len(content) + (content[-1:] != b"\n") or zlib.crc32(content[body:stop], zlib.crc32(content[at : at + HEADER.size])) != check:
            raise ValueError(f"the block at byte {at} is damaged")
        yield head, np.frombuffer(content, ROW, head[4], body), bytes(content[body + head[4] * ROW.itemsize : stop])
        at = stop + 1


def decoded(content: memoryview) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, document rows and ids of a file. ids that do not have their block's checksum raise ValueError."""
    return decoded_together([content])[0]


def decoded_together(contents: list[memoryview]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What ``decoded`` gives for each file; their blocks are coded side by side, so that a step is for more of them."""
    files = [list(parse(content)) for content in contents]
    found, ids = [block for blocks in files for block in blocks], []
    for wide in (0, 1):
        same = [i for i, (head, _, _) in enumerate(found) if head[1] == wide]
        for at in range(0, len(same), idcoder.LANES):
            part = same[at : at + idcoder.LANES]
            ids += zip(part, idcoder.decode([found[i][2] for i in part], [found[i][0][5] for i in part], bool(wide)), strict=True)
    ids = [got for _, got in sorted(ids, key=lambda x: x[0])]
    for (head, _, _), got in zip(found, ids, strict=True):
        if zlib.crc32(got.astype("<u4", copy=False)) != head[7]:
            raise ValueError(f"the ids from place {head[3]} of file {head[2]} are damaged")
    out, at = [], 0
    for blocks in files:
        out.append((blocks[0][0][2], np.concatenate([r for _, r, _ in blocks]), np.concatenate(ids[at : at + len(blocks)])))
        at += len(blocks)
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, place, ids binary) of all documents of the files below ``path``; ``place`` counts the ids before it in its file.

    ids are little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer.cache_clear()  # a worker that wrote before keeps no words while it reads
        held: list[memoryview] = []

        def flush() -> Iterator[pa.RecordBatch]:
            files = decoded_together(held)
            held.clear()
            while files:
                file, rows, ids = files.pop(0)
                raw, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(rows["n"].astype(np.int64))
                for at in range(0, len(rows), 4096):
                    part, end = rows[at : at + 4096], ends[at : at + 4096]
                    begin = end - part["n"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), file, np.int32)), pa.array(part["doc_id"].astype(np.int64), mask=part["none"] == 1), pa.array(begin), pa.array([raw[4 * a : 4 * b] for a, b in zip(begin, end, strict=True)], pa.binary())],
                        ["file", "doc_id", "place", "ids"],
                    )

        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                if len(data):
                    held.append(data)
                if sum(map(len, held)) >= TOGETHER:
                    yield from flush()
        if held:
            yield from flush()

    with small_batches(spark, 1 << 20):
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "file int, doc_id long, place long, ids binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and crc32 of the ids.

    Only one number for each file, its count of ids, is gathered: files are as few as tasks.
    """
    from tessera.llm.common import stored

    found = stored(found.select("file", "doc_id", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    start, before = {}, 0
    for file, n in sorted(found.groupBy("file").agg(F.sum("n_tokens")).collect()):
        start[file], before = before, before + n
    first = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("file")) if start else F.lit(0)
    return found.select("doc_id", (first.cast("long") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digest(read_ids(spark, path))


QUERIES = {"op12_token_binary": op12_token_binary}
