"""Reading and writing of records, and views of the driver's tables as records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.sources.stored import cached, stored

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
_TSV = {"sep": "\t", "header": True, "quote": "", "emptyValue": ""}


def raw_path(root: str, split: str, source: int | None) -> str:
    """``<root>/<split>/<split>_source<k>.tsv``, or the split's ground truth."""
    return f"{root}/{split}/{split}_" + ("ground_truth" if source is None else f"source{source}") + ".tsv"


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """All strings, quotes are data, missing fields are empty."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote="").csv(path).na.fill("")


def normalized(raw: DataFrame) -> DataFrame:
    """(id, country, name_n, addr_n, is_domain, name_sq) of raw records."""
    named = raw.withColumn("_n", X.norm_name(F.col("business_name")))
    return named.select(
        F.col("entity_id").alias("id"), "country", F.col("_n.name").alias("name_n"), X.norm_addr(F.col("business_address")).alias("addr_n"), F.col("_n.is_domain").alias("is_domain"), X.squash(F.col("_n.name")).alias("name_sq")
    )


def load_normalized(spark: SparkSession, raw: Callable[[], DataFrame], cache: str, refresh: bool = False) -> DataFrame:
    """Read-through Parquet cache, by country, of what ``raw`` gives."""
    return cached(spark, cache, lambda: normalized(raw()), "country", refresh=refresh)


def placed(entities: DataFrame) -> DataFrame:
    """Entities with ``pos``, their place by id: a running number within ranges of ids, behind the counts of the ranges before."""
    ranges = stored(entities.repartitionByRange("id").sortWithinPartitions("id").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # one row for each range
    n = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = n.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranges.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1, other), one row for each match."""
    return truth.where(F.col("matched_entity_ids") != "").select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("other"))


def write_lists(rows: DataFrame, path: str, order: str = "pos") -> None:
    """One headed TSV file in the order of ``order``, never quoted, empty lists as empty bytes.

    Ranges of rows are written side by side; the file system puts their files behind one another.
    """
    spark = rows.sparkSession
    parts = f"{path.rstrip('/')}_parts"
    out = rows.orderBy(order).drop(order)
    out.write.mode("overwrite").options(**_TSV | {"header": False}).csv(parts)
    _joined(spark, parts, f"{path.rstrip('/')}/part-00000.tsv", "\t".join(out.columns) + "\n")


def _joined(spark: SparkSession, parts: str, target: str, head: str) -> None:
    """``head`` and the files of ``parts`` in the order of their names as one file. HDFS moves their blocks; elsewhere bytes are copied in small pieces."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    folder, to = path(parts), path(target)
    fs = folder.getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda f: f.getName())
    fs.delete(to.getParent(), True)
    out = fs.create(to, True)
    out.write(bytearray(head.encode()))
    if fs.getScheme() != "hdfs":
        for f in files:
            source = fs.open(f)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    out.close()
    if fs.getScheme() == "hdfs" and files:
        array = spark.sparkContext._gateway.new_array(path, len(files))
        for k, f in enumerate(files):
            array[k] = f
        fs.concat(to, array)
    fs.delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first 6 words are the name, all others the address, lang the country; role 0 (reference), 1 or 2 by source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = d.select("doc_id", "lang", "source", X.head_and_rest(F.col("text"), 6).alias("w"))
    name = F.array_join(X.without_runs(X.split_words(F.col("w.head"))), " ")
    addr = F.col("w.rest")
    role = (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 3).alias("role")
    return own.select(F.concat(F.lit("S"), (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("country"), name.alias("name_n"), addr.alias("addr_n"), F.lit(False).alias("is_domain"), X.squash(name).alias("name_sq"), role)


def bucket(x: Column, seed: int, k: int) -> Column:
    """A hash bucket that SQL engines agree on."""
    return (F.conv(F.substring(F.md5(F.concat(x, F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("long")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records (role 0) and corrupted copies of them (roles 1 and 2), with the owner of each copy.

    A copy's name has its first two words swapped (role 1) or its last letter gone (role 2); a fourth of
    all copies lose their address, and a fifth get another number and have no owner. Half of the copies of role 1 write
    "gizmo" in another script, half of role 2 shorten "medium", and an eighth of role 2 are written as a domain.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    part = t("part").select((F.col("p_partkey")).alias("k"), F.lower(F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "[^A-Za-z0-9]", " "))).alias("p"))
    n_part = t("part").agg(F.max("p_partkey") + 1).first()[0]
    own = (
        t("customer")
        .join(F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("k", F.col("c_custkey") % n_part)
        .join(part, "k")
        .select("c_custkey", F.lower("r_name").alias("country"), X.tokens(F.col("p")).alias("w"), F.replace(F.lower(F.concat_ws(" ", (F.col("c_custkey") % 977).cast("string"), "c_mktsegment", "n_name")), F.lit("_"), F.lit(" ")).alias("addr"))
    )
    key = F.col("c_custkey").cast("string")
    other = lambda seed, word, becomes: F.transform("w", lambda t: F.when((t == word) & (bucket(key, seed, 2) == 0), becomes).otherwise(t))
    native, short, domain = other(8, "gizmo", "कमल"), F.array_join(other(9, "medium", "med"), " "), bucket(key, 10, 8) == 0
    swapped = F.array_join(F.concat(F.slice(native, 2, 1), F.slice(native, 1, 1), F.slice(native, 3, 20)), " ")
    plain = F.array_join("w", " ")
    clipped = F.substring(short, F.lit(1), F.greatest(F.length(short) - 1, F.lit(1)))
    clipped = F.when(domain, X.squash(clipped)).otherwise(clipped)
    blank = bucket(key, 3, 4) == 0
    lost = lambda role: bucket(key, role, 5) == 0
    number = lambda role: F.when(lost(role), F.concat(F.lit("9"), F.col("addr"))).otherwise(F.col("addr"))

    def record(role: int, name: Column, addr: Column, owner: Column) -> DataFrame:
        return own.select(F.concat(F.lit(f"S{role + 1}-"), key).alias("id"), "country", name.alias("name_n"), addr.alias("addr_n"), (domain if role == 2 else F.lit(False)).alias("is_domain"), X.squash(name).alias("name_sq"), F.lit(role).alias("role"), owner.alias("owner"))

    copy = lambda role, name: record(role, name, F.when(blank, F.lit("")).otherwise(number(role)), F.when(~lost(role), F.concat(F.lit("S1-"), key)))
    return record(0, plain, F.col("addr"), F.concat(F.lit("S1-"), key)).unionByName(copy(1, swapped)).unionByName(copy(2, clipped))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored pairs: (q_id, s1_id, p), p a fixed function of the keys."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    q = F.concat(F.when(F.col("l_orderkey") % 2 == 0, F.lit("S2-")).otherwise(F.lit("S3-")), F.col("l_orderkey").cast("string"))
    p = ((F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % 1000).cast("double") / 1000
    return line.select(q.alias("q_id"), F.concat(F.lit("S1-"), F.col("l_suppkey").cast("string")).alias("s1_id"), p.alias("p")).groupBy("q_id", "s1_id").agg(F.max("p").alias("p"))
