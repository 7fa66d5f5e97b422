"""A Merkle manifest of a dataset: one root for all rows, and for each row a proof that leads from it to the root.

Each group (``source``) has a tree over its rows by ascending doc_id, and one more tree stands on the groups' roots. A row's
place in its tree is its rank, and the rank's digits in base ``FANOUT`` are its path in a trie: rows that share all
but the last digits share a subtree. So nothing is sorted as a whole:

* ranks come from histograms of doc_id digits, the leading ones first. A bucket that holds too many rows is split by the
  next digits; the few rows of a bucket get their ranks by a window of their own;
* rows that share all but the last ``DEPTH`` digits of their rank meet in one group of ``FANOUT ** DEPTH`` rows at most, whose subtree
  is computed there. Its root goes on with the remaining digits, until one is left;
* on the way down each subtree learns the path above it, so a proof is the part within the subtree and that path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

FANOUT, DEPTH = 3, 6
#: Digits have so many bits; buckets of more rows than ``BUCKET`` are split.
DIGIT, BUCKET = 12, 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = "array<struct<left:binary,right:binary>>"


def leaf(values: list[Column]) -> Column:
    """Lowercase hex sha256 of all values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def up(level: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(level[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(level), FANOUT)]


def subtree(level: list[bytes], n: int, depth: int) -> list[list[bytes]]:
    """All levels of a subtree of a tree of n nodes, from ``level`` to its root: ``depth`` more, or fewer if the tree ends."""
    out = [level]
    for _ in range(depth):
        if n == 1:
            break
        out.append(up(out[-1]))
        n = -(-n // FANOUT)
    return out


def siblings(levels: list[list[bytes]], i: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of node i and of its ancestors in their runs."""
    for level in levels[:-1]:
        first = i - i % FANOUT
        yield b"".join(level[first:i]), b"".join(level[i + 1 : first + FANOUT])
        i //= FANOUT


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its path lead to."""
    for left, right in path:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def ranked(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``rank`` (from 0, within ``grp``, by doc_id, then leaf; no doc_id first) and ``total``, the rows of ``grp``.

    ``rows``: grp, doc_id long, leaf (hex), n: as so many equal rows it counts; it takes the ranks from ``rank`` on.
    """
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    bits = ((low + (1 << 63)) ^ (high + (1 << 63))).bit_length() if low is not None else 0
    key = F.col("doc_id").bitwiseXOR(F.lit(-1 << 63))
    digits = [F.coalesce(F.shiftrightunsigned(key, s).bitwiseAND((1 << DIGIT) - 1), F.lit(-1)) for s in range(max(0, bits - DIGIT), 0, -DIGIT)] + [F.coalesce(key.bitwiseAND((1 << DIGIT) - 1), F.lit(-1))]
    digits += [F.conv(F.substring("leaf", 1 + 3 * i, 3), 16, 10).cast("long") for i in range(21)]
    open_, done = rows.withColumns({"base": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}), []
    for k, digit in enumerate(digits):
        open_ = open_.withColumn("digit", digit)
        order = Window.partitionBy("grp", "base").orderBy("digit")
        counts = open_.groupBy("grp", "base", "digit").agg(F.sum("n").alias("c"), F.count("*").alias("held"))
        starts = counts.select("grp", "base", "digit", "held", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("grp", "base")).alias("all"))
        starts = stored(starts)
        joined = open_.join(starts, ["grp", "base", "digit"])
        joined = joined.withColumns({"base": F.col("base") + F.col("before"), "total": F.col("all") if k == 0 else F.col("total")})
        done.append(joined.where(F.col("held") <= bucket).select(*rows.columns, "base", "total"))
        if starts.where(F.col("held") > bucket).isEmpty():
            break
        open_ = stored(joined.where(F.col("held") > bucket).select(*rows.columns, "base", "total"))
    else:
        done.append(open_)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    order = Window.partitionBy("grp", "base").orderBy(F.asc_nulls_first("doc_id"), "leaf").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("rank", F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0))).drop("base")


def packed(nodes: DataFrame, members: list[str], depth: int) -> DataFrame:
    """Subtrees (grp, prefix, total, members, node) of the nodes (grp, rank, total, leaf) that share their leading digits of the rank."""
    per = F.sort_array(F.collect_list(F.struct("rank", "leaf", *members))).alias("members")
    groups = nodes.groupBy("grp", F.expr(f"rank div {FANOUT**depth}").alias("prefix"), "total").agg(per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for held, n in zip(batch.column("members"), batch.column("total").to_pylist(), strict=True):
                level = held.values.field("leaf").to_pylist()
                found.append(subtree([x.encode() for x in level], n, depth)[-1][0].decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "node"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)
    return stored(groups.mapInArrow(run, f"{kinds}, node string"))


def climb(nodes: DataFrame, members: list[str], depth: int) -> list[DataFrame]:
    """Rounds of subtrees, from the nodes to one root for each grp."""
    rounds, span = [], FANOUT**depth
    while True:
        packs = packed(nodes, members, depth)
        rounds.append(packs)
        more = F.ceil(F.col("total") / span).cast("long")
        nodes, members = packs.where(F.col("total") > span).select("grp", F.col("prefix").alias("rank"), more.alias("total"), F.col("node").alias("leaf")), []
        if nodes.isEmpty():
            return rounds


def within(packs: DataFrame, depth: int, schema: str, result: Callable[[dict, list[list[bytes]], int, list], tuple]) -> DataFrame:
    """For each member of the subtrees (with the columns ``above`` and others) a row: ``result(pack, levels, i, above)``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    types = list(to_arrow_schema(kind).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pack = batch.slice(at, 1).to_pylist()[0]  # one at a time: as Python objects a batch would be many times its size
                above = [(a["left"], a["right"]) for a in pack["above"]]
                levels = subtree([m["leaf"].encode() for m in pack["members"]], pack["total"], depth)
                rows = [result(pack, levels, i, above) for i in range(len(pack["members"]))]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], kind.names)

    return packs.mapInArrow(run, kind)


def _path(levels: list[list[bytes]], i: int, above: list) -> list[dict]:
    return [{"left": a, "right": b} for a, b in [*siblings(levels, i), *above]]


def paths(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The first round's subtrees with ``above``, the path from each subtree's root on. ``tops``: (grp, above, ...) of the trees' roots."""
    extra = [c for c in tops.columns if c not in ("grp", "above")]
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in tops.schema if f.name in extra)
    found, span = None, FANOUT**depth
    for k in range(len(rounds) - 1, -1, -1):
        last = rounds[k].where(F.col("total") <= span).join(tops, "grp")
        if found is not None:
            last = last.unionByName(rounds[k].where(F.col("total") > span).join(found, ["grp", "prefix"]).select(last.columns))
        if k:
            schema = f"grp string, prefix long, above {LEVELS}{kinds}"
            found = stored(within(last, depth, schema, lambda p, levels, i, above: (p["grp"], p["members"][i]["rank"], _path(levels, i, above), *[p[c] for c in extra])))
    return last


@dataclass
class Manifest:
    """The root (None without rows), the group roots (source, subroot), and the subtrees of the rows with their paths."""

    root: str | None
    subroots: DataFrame
    packs: DataFrame
    depth: int

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, path) of every row: ``fold`` of leaf and path is the root."""
        return within(self.packs, self.depth, f"doc_id long, leaf string, path {LEVELS}", lambda p, levels, i, above: (p["members"][i]["doc_id"], p["members"][i]["leaf"], _path(levels, i, above)))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", bucket: int = BUCKET, depth: int = DEPTH, **members: Column) -> Manifest:
    """The manifest of all rows of ``docs``; other columns than ``columns`` are not part of it.

    Rows ascend by doc_id, those without one first; rows that repeat a doc_id follow by their leaf, and equal rows all count. A null
    ``group`` is a group, before all others. ``members``: columns that the subtrees carry along for each row.
    """
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(f"`{c}`") for c in columns]).alias("leaf"), *[c.alias(n) for n, c in members.items()])
    # equal leaves are equal rows, so one row with its count stands for them
    rows = stored(rows.groupBy("grp", "doc_id", "leaf").agg(F.count("*").alias("n"), *[F.first(m).alias(m) for m in members]))
    placed = ranked(rows, bucket)
    each = placed.withColumn("rank", F.explode(F.sequence("rank", F.col("rank") + F.col("n") - 1))).drop("n")
    rounds = climb(each, ["doc_id", *members], depth)
    trees = rounds[0]
    for r in rounds[1:]:
        trees = trees.select("grp", "prefix", "total", "node").unionByName(r.select("grp", "prefix", "total", "node"))
    # groups in order: each range of them counts its own, and the ranges' counts (one for each task) say where it starts
    groups = stored(trees.where(F.col("total") <= FANOUT**depth).select("grp", F.col("node").alias("subroot")))
    placed = stored(groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("at", F.monotonically_increasing_id()))
    part, before, starts = F.shiftright("at", 33), 0, [F.lit(-1), F.lit(0)]
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts += [F.lit(p), F.lit(before)]
        before += n
    rank = F.element_at(F.create_map(*starts), part).cast("long") + F.col("at").bitwiseAND((1 << 33) - 1)
    nodes = placed.select("grp", "subroot", rank.alias("rank"))
    whole = climb(nodes.select(F.lit("").alias("grp"), "rank", F.col("subroot").alias("leaf"), F.lit(before).cast("long").alias("total"), F.col("grp").alias("own")), ["own"], depth)
    top = whole[-1].where(F.col("total") <= FANOUT**depth).select("node").first()
    root = top[0] if top else None
    session = docs.sparkSession
    start = session.createDataFrame([("", [])], f"grp string, above {LEVELS}")
    over = paths(whole, start, depth)
    tops = within(over, depth, f"grp string, above {LEVELS}, subroot string", lambda p, levels, i, above: (p["members"][i]["own"], _path(levels, i, above), p["members"][i]["leaf"]))
    subroots = groups.select(F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(group), "subroot")
    return Manifest(root, subroots, paths(rounds, stored(tops), depth), depth)


def audit(made: Manifest, claimed: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, whose leaf is now claimed to be the member ``claimed``."""
    root = made.root

    def result(p: dict, levels: list[list[bytes]], i: int, above: list) -> tuple:
        path, m = [*siblings(levels, i), *above], p["members"][i]
        folded = fold(m[claimed].encode(), path).decode()
        return m["doc_id"], m["leaf"], p["subroot"], root, sha256(b"".join(a + b for a, b in path)).hexdigest(), folded, folded == root

    return within(made.packs, made.depth, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", result)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    return audit(manifest(docs, claimed=claimed), "claimed")


ORACLES = {
    "op13_merkle_manifest": """
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
    SELECT doc_id, source, lang, n_chars, text,
        list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) & 1 = 1 AS changed
    FROM documents, crc_table
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || CASE WHEN changed THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), nodes AS (
    SELECT source, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM numbered
    UNION ALL
    SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n
), subroots AS (
    SELECT source, h AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3, n
), runs AS (
    SELECT source, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
    SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY ALL
), low AS (
    SELECT source, i AS first_i, 0 AS level, i, claimed AS h, '' AS proof FROM numbered
    UNION ALL
    SELECT low.source, low.first_i, low.level + 1, low.i // 3,
        sha256(array_to_string(hs[:low.i % 3], '') || low.h || array_to_string(hs[low.i % 3 + 2:], '')), low.proof || array_to_string(hs[:low.i % 3], '') || array_to_string(hs[low.i % 3 + 2:], '')
    FROM low JOIN runs ON runs.source IS NOT DISTINCT FROM low.source AND runs.level = low.level AND runs.run = low.i // 3
), high AS (
    SELECT low.source, low.first_i, 0 AS level, s.i, low.h, low.proof FROM low JOIN subroots s ON s.source IS NOT DISTINCT FROM low.source AND low.level = s.depth
    UNION ALL
    SELECT high.source, high.first_i, high.level + 1, high.i // 3,
        sha256(array_to_string(hs[:high.i % 3], '') || high.h || array_to_string(hs[high.i % 3 + 2:], '')), high.proof || array_to_string(hs[:high.i % 3], '') || array_to_string(hs[high.i % 3 + 2:], '')
    FROM high JOIN top_runs r ON r.level = high.level AND r.run = high.i // 3
), root AS (
    SELECT h AS root, level AS depth FROM tops WHERE n = 1
)
SELECT x.doc_id, x.leaf, s.subroot, root.root, sha256(high.proof) AS proof_sha256, high.h AS folded_root, high.h = root.root AS verified
FROM numbered x JOIN subroots s ON s.source IS NOT DISTINCT FROM x.source JOIN root ON true
JOIN high ON high.source IS NOT DISTINCT FROM x.source AND high.first_i = x.i AND high.level = root.depth
"""
}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
