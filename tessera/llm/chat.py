"""Reply trees to chat-formatted conversations.

Paths from root to leaf are enumerated by self-joins that double the distance climbed each time, so a
tree of depth d takes about log2(d) joins. Branches are ranked by their mean score; each chosen path
becomes one conversation. The template marks every turn; control strings inside texts get one backslash
after their bracket, and strings that already look so get one more, which makes the escape reversible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

#: What opens and closes a turn. Any other role is written in hexadecimal in its opening mark.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>")}
OPEN_OTHER, CLOSE_OTHER = "[ROLE:{}] ", " [/ROLE]"
BEGIN = "<s>"
_CONTROL = r"(/?(?:s>|(?:INST|SYS|ANS|ROLE)\]|ROLE:[0-9A-F]*\]))"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"\[(SYS|INST|ANS|ROLE:[0-9A-F]*)\] (.*?) (?:\[/(?:SYS|INST|ROLE)\]|</s>)", re.S)
_ROLES = {v[0][1:-2]: k for k, v in MARKS.items()}


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss mask: spans, in code points, of what the assistant says."""
    out, at, mask = [BEGIN], len(BEGIN), []
    for role, text in turns:
        head, tail = MARKS.get(role) or (OPEN_OTHER.format(role.encode().hex().upper()), CLOSE_OTHER)
        text = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(text)))
        out += [head, text, tail]
        at += len(head) + len(text) + len(tail)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of ``render``'s output."""
    return [(_ROLES.get(m[1]) or bytes.fromhex(m[1][5:]).decode(), unescape(m[2])) for m in _TURN.finditer(formatted)]


_SAME = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def rooted(own: DataFrame, up: DataFrame) -> DataFrame:
    """(tree, node) of the nodes that a root can be reached from; ``up`` holds (tree, node, above) for nodes with a parent.

    Each round doubles the distance: after round k all nodes less than 2 ** k below a root are known. A round
    that finds none ends it, so cycles, and what hangs on them, cost no further round.
    """
    known = stored(own.select("tree", "node").alias("a").join(up.alias("b"), _SAME("a", "b") & F.col("a.node").eqNullSafe(F.col("b.node")), "left_anti"))
    jump = up
    while True:
        new = stored(jump.alias("a").join(known.alias("b"), _SAME("a", "b") & (F.col("a.above") == F.col("b.node"))).select("a.tree", "a.node"))
        if new.isEmpty():
            return known
        known = stored(known.unionByName(new))
        rest = jump.alias("a").join(new.alias("b"), _SAME("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
        jump = stored(rest.alias("a").join(jump.alias("b"), _SAME("a", "b") & (F.col("a.above") == F.col("b.node"))).select("a.tree", "a.node", "b.above"))


def reply_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, turns) of the ``best`` branches of each tree.

    ``nodes`` has tree, node, parent (null or unknown: a root), role, text, score; further columns are ignored.
    ``turns`` lists (depth, role, text) from the root; a branch's score is the mean of its nodes' (null: 0), ties go to
    the smaller leaf. Trees may be null. Rows that repeat a node are one node, the least by parent, role, text and
    score. Nodes of a cycle have no root, so they and their descendants are on no path.
    """
    fields = ["parent", "role", "text", "score"]
    nodes = nodes.groupBy("tree", "node").agg(F.min(F.struct(*fields)).alias("n")).select("tree", "node", *[f"n.{f}" for f in fields])
    own = stored(nodes.select("tree", "node", "parent"))
    up = stored(own.alias("a").join(own.alias("b"), _SAME("a", "b") & (F.col("a.parent") == F.col("b.node"))).select("a.tree", "a.node", F.col("b.node").alias("above")))
    known = rooted(own, up)
    in_tree = lambda d: d.alias("a").join(known.alias("k"), _SAME("a", "k") & F.col("a.node").eqNullSafe(F.col("k.node")), "left_semi")
    up = stored(in_tree(up))
    leaves = known.alias("a").join(up.alias("b"), _SAME("a", "b") & (F.col("a.node") == F.col("b.above")), "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    step = 1
    while not up.isEmpty():
        climbed = paths.alias("p").join(up.alias("u"), _SAME("p", "u") & (F.col("p.node") == F.col("u.node")))
        paths = stored(paths.unionByName(climbed.select("p.tree", "p.leaf", F.col("u.above").alias("node"), (F.col("p.height") + step).alias("height"))))
        up = stored(up.alias("a").join(up.alias("b"), _SAME("a", "b") & (F.col("a.above") == F.col("b.node"))).select("a.tree", "a.node", "b.above"))
        step *= 2
    full = paths.alias("p").join(nodes.alias("n"), _SAME("p", "n") & F.col("p.node").eqNullSafe(F.col("n.node")))
    full = full.select("p.tree", "p.leaf", "p.height", "n.role", "n.text", F.coalesce("n.score", F.lit(0.0)).alias("score"))
    rows = full.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("depth"), "role", "text"))).alias("turns"))
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def format_paths(paths: DataFrame) -> DataFrame:
    """Columns of ``paths`` but ``turns``, with ``formatted`` and ``loss_spans``, which replace columns of those names. A null role or text is empty."""
    names = [c for c in paths.columns if c not in ("turns", "formatted", "loss_spans")]
    kept = paths.select(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "formatted string, loss_spans array<struct<start: bigint, end: bigint>>"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(t["role"] or "", t["text"] or "") for t in x.as_py()]) for x in b.column(0)]
            spans = pa.array([[{"start": s, "end": e} for s, e in mask] for _, mask in done], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in done], pa.string()), spans], names=[*names, "formatted", "loss_spans"])

    return paths.select("turns", *names).mapInArrow(run, schema)


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """What ``formatted`` and ``loss_spans`` hold, read back from them alone; one row for each row, whatever its key, null or repeated."""
    import hashlib

    kind = formatted.select(key).schema[0].dataType.simpleString()
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = [*zip(*rows, strict=True)] or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([*c], t) for c, t in zip(cols, types, strict=True))], names=names)

    return formatted.select(key, "formatted", "loss_spans").mapInArrow(run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_nodes(conversations: DataFrame) -> DataFrame:
    """A table of turns as trees without branches, so that ranking has one path to choose: each row replies to the one before it.

    Rows are in order of turn, role and text, nulls first; equal rows are as many turns. A null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return own.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one with control strings as its texts; a null text is empty, and so is a null role."""
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    nodes = as_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    return digests(format_paths(reply_paths(nodes).withColumnRenamed("tree", "conv_id").select("conv_id", "turns")), "conv_id")


QUERIES = {"op6_chat": op6_chat}
ORACLES = {
    "op6_chat": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')) v),
e as (select *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ANS|ROLE)\]|ROLE:[0-9A-F]*\]))', '\1\2\\\3', 'g')) as n from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, r0 nulls first, t0 nulls first)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, r0 nulls first, t0 nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(n + case role when 'user' then 15 when 'assistant' then 11 when 'system' then 13 else 16 + 2 * octet_length(encode(role)) end) as bigint) as formatted_chars
from e group by conv_id"""
}
