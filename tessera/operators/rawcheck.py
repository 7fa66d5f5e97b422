"""Checks of a written list file line by line: what parsing would hide, a broken header or a row without a tab, is seen here.

Lines are read where they lie, by all tasks. A line's number is its place among the lines of its stretch of the file plus
the lines of the stretches before; only one row for each stretch is brought together for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.stored import stored

MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of the files at ``path``, from 1."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    rows = stored(rows)
    parts = rows.groupBy("file", "at").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(parts.withColumn("before", before)), ["file", "at"]).select("file", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), "value")


def header_faults(lines: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """(rule, file, line, id) of files whose first line is not ``header``: comma_header without a tab, else wrong_header with what it says."""
    first = lines.where("line = 1")
    said = F.transform(F.split("value", "\t"), lambda c: F.lower(F.trim(c)))
    commas = ~F.col("value").contains("\t") & F.col("value").contains(",")
    bad = first.where(commas | (said != F.array(*map(F.lit, header))))
    return bad.select(F.when(commas, "comma_header").otherwise("wrong_header").alias("rule"), "file", "line", F.col("value").alias("id"))


def _rows(lines: DataFrame) -> DataFrame:
    """(file, line, s1, ids) of the rows with a tab; a blank list has no ids."""
    body = lines.where("line > 1").where(F.col("value").contains("\t"))
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    none = F.array().cast("array<string>")
    return body.select("file", "line", F.substring_index("value", "\t", 1).alias("s1"), F.when(F.trim(F.regexp_replace(rest, r"\s", "")) == "", none).otherwise(F.split(rest, ",")).alias("ids"))


def violations(lines: DataFrame, entities: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, header: tuple[str, ...] = MATCHES) -> DataFrame:
    """(rule, file, line, id) of everything wrong with ``numbered_lines`` of one list file.

    entities (id): who needs a row; known (id): all records, if ids are to be looked up; candidates: the lines of a candidate file, whose
    lack of a match is a warning. A file with a wrong header is not read any further. Rules: empty_file, comma_header, wrong_header,
    malformed_row, duplicate_row and duplicate_id (with the entity), self_match, wrong_prefix, unknown_id (with the record),
    missing_entity, extra_entity, warning_not_a_candidate. ``line`` is null where a rule is about the whole file.
    """
    lines = stored(lines)
    spark = lines.sparkSession
    if lines.isEmpty():
        return spark.createDataFrame([("empty_file", None, None, None)], "rule string, file string, line long, id string")
    heads = stored(header_faults(lines, header))
    lines = lines.join(F.broadcast(heads.select("file")), "file", "left_anti")
    rows = stored(_rows(lines))
    each = rows.select("file", "line", "s1", F.explode("ids").alias("id"))
    none, whole = F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line")
    ours = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")

    def rule(name: str, df: DataFrame, value: str | Column = "id") -> DataFrame:
        return df.select(F.lit(name).alias("rule"), "file", "line", (F.col(value) if isinstance(value, str) else value).alias("id"))

    first = rows.groupBy("s1").agg(F.min(F.struct("file", "line")).alias("f"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, "s1").where((F.col("file") != F.col("f.file")) | (F.col("line") != F.col("f.line")))
    found = [
        heads,
        rule("malformed_row", lines.where((F.col("line") > 1) & ~F.col("value").contains("\t") & (F.trim("value") != "")), "value"),
        rule("duplicate_row", again, "s1"),
        rule("duplicate_id", rows.where(F.size("ids") > F.size(F.array_distinct("ids"))), "s1"),
        rule("self_match", each.where(F.col("id").startswith("S1-")).distinct()),
        rule("wrong_prefix", each.where(~F.col("id").startswith("S1-") & ~ours).distinct()),
        rule("extra_entity", rows.join(entities.select(F.col("id").alias("s1")), "s1", "left_anti"), "s1"),
    ]
    if heads.isEmpty():
        found.append(rule("missing_entity", entities.join(rows.select(F.col("s1").alias("id")), "id", "left_anti").select("id", none, whole)))
    if known is not None:
        found.append(rule("unknown_id", each.where(ours).join(known.select("id"), "id", "left_anti").distinct()))
    if candidates is not None:
        allowed = _rows(stored(candidates)).select("s1", F.explode("ids").alias("id")).distinct()
        found.append(rule("warning_not_a_candidate", each.join(allowed, ["s1", "id"], "left_anti").distinct()))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
