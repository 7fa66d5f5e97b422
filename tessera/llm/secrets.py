"""Secret scans: every rule in one pass of a combined deterministic automaton over each whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.automaton import Scanner
from tessera.llm.common import table

#: (kind, pattern, letters in either case, least length of the whole match). The first three are the base.
#: Hexadecimal runs state their least length in the pattern, which gives the same matches and far fewer stops.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 18),
    ("hex", r"[0-9a-f]{16,}", False, 16),
    ("private", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", False, 0),
    ("webtoken", r"eyJ[A-Za-z0-9_.-]+", False, 40),
    ("hub", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
]
BASE = ("assign", "access", "hex")
LEAST_VALUE = 12
_NAME = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?")


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner([(p, fold) for _, p, fold, _ in RULES])


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of RULES."""
    data = text.encode("utf-8", "surrogatepass")
    found = []
    for rule, start, end in scanner().scan(data):
        kind, _, _, least = RULES[rule]
        if end - start < least or kind == "assign" and end - _NAME.match(data, start, end).end() < LEAST_VALUE:
            continue
        found.append((start, rule, kind, end))
    found.sort()
    if len(data) == len(text):
        return [(kind, start, end) for start, _, kind, end in found]
    at = {0: 0}
    last = 0
    for x in sorted({y for s, _, _, e in found for y in (s, e)}):
        at[x] = at[last] + len(data[last:x].decode("utf-8", "replace"))
        last = x
    return [(kind, at[start], at[end]) for start, _, kind, end in found]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, with ``secrets``: array of (kind, start, end), ends exclusive.

    A null or empty text has none. Rows are independent: nothing is shuffled, and rows that repeat a text, with whatever
    doc_id, get the same spans. Spans that begin at one place are in the order of the rules. A column ``secrets`` is replaced.
    """
    names = [c for c in docs.columns if c not in (text, "secrets")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "secrets array<struct<kind: string, start: bigint, end: bigint>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py() or "")] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(spans, kind)], names=[*names, "secrets"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
