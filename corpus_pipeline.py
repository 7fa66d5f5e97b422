"""Documents to packed training sequences: rules, line dedup, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of ``documents``; the
last returns the pieces of the packed sequences. Between stages the documents are written as Parquet to the
shared folder and read again, so a lost executor costs at most the stage it was in.

Every stage gives an empty table for an empty one, keeps columns it does not know, whatever their names, and treats a
null text as an empty one. What else it does with nulls, ties and repeats is said below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_templates, ngram_join, packing, quality_rules
from tessera.llm.common import stored, table

#: Rows to take out are broadcast up to this many (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def without(docs: DataFrame, gone: DataFrame, *by: Column) -> DataFrame:
    """The rows of ``docs`` whose values ``by`` are not a row of ``gone``; null equals null."""
    gone = stored(gone.distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*by).alias("by"))
    same = [F.col(f"by.{f}").eqNullSafe(F.col(f"gone.{c}")) for f, c in zip(rows.schema["by"].dataType.names, gone.columns, strict=True)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(gone.alias("gone"), condition, "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; so do those without words. Each row is judged by its own text, with or without doc_id."""
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; ``n_chars`` follows the text. All rows stay, also those whose text becomes empty; a null text stays null."""
    out = line_templates.dedup_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Texts without words, and rows without doc_id, are copies of nothing and stay. Rows that repeat a doc_id are one
    document: one row stays, the one of the least hash of its text.
    """
    out = without(docs, ngram_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id"), F.col("doc_id").cast("long"))
    twice = stored(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"))
    if twice.isEmpty():
        return out
    rows = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    apart = rows.join(twice, F.col("row.doc_id") == F.col("again"), "left_anti")
    order = Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text"))
    one = rows.join(twice, F.col("row.doc_id") == F.col("again"), "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").select("row")
    return apart.unionByName(one).select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows are told apart by doc_id and text, so a leak takes no other row with it."""
    found = decontaminate.report(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id", "mark"), F.col("doc_id"), decontaminate.mark("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, also of empty texts (one end token) and of rows without doc_id."""
    import public_tokenizers

    return packing.digest(packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark_leaks), ("packing", pack)]
#: SQL has no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
