"""Candidate retrieval through an inverted index of capped keys. Country is part of every key, count and vocabulary."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.functions import text as X
from tessera.operators import aliases
from tessera.operators import keys as K
from tessera.sources.records import placed
from tessera.sources.stored import complete, stored

FAMILIES = {"n": "k_name", "a": "k_addr", "b": "k_bigram", "q": "k_sq", "p": "k_pair", "h": "k_numpair", "x": "k_addrbag", "c": "k_cross"}


#: Hot keys and an index are broadcast up to this many bytes, counted; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass
class Index:
    """Reference keys within their caps, as posting lists (country, fam, key, ids), records by country (country, n1) and what the keys were made with.

    Inside, records are numbers in the order of their ids; ``names`` (num, id) has their ids.
    """

    lists: DataFrame
    sizes: DataFrame
    vocab: DataFrame
    names: DataFrame
    stop: DataFrame | None = None
    words: DataFrame | None = None
    classes: DataFrame | None = None
    #: Bytes of the lists, where they are known.
    bytes: int | None = None

    @property
    def keys(self) -> DataFrame:
        """(id, country, fam, key, df)."""
        each = self.lists.select(F.explode("ids").alias("num"), "country", "fam", "key", F.size("ids").alias("df"))
        return each.join(self.names, "num").select("id", "country", "fam", "key", "df")


#: Bytes of posting lists in a bucket of a kept index.
BUCKET_BYTES = 64 << 20
_PARTS = ("sizes", "vocab", "names", "stop", "words", "classes")


def _table(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The bucketed lists below ``path``: a table of the session's catalogue, whose files stay where they are."""
    name = f"tessera_lists_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"create table if not exists {name} (country string, fam string, key string, ids array<bigint>) using parquet clustered by (country, key) sorted by (country, key) into {buckets} buckets location '{path}/lists'")
    return spark.table(name)


def keep_index(index: Index, path: str, about: str) -> Index:
    """Writes an index below ``path`` and gives it as ``kept_index`` does. The manifest comes last, so an index with one is whole.

    Lists are bucketed by their keys: a probe deals out query keys alone and leaves the lists where they are.
    """
    spark = index.lists.sparkSession
    size = int(index.lists.agg(F.sum(_list_bytes())).first()[0] or 0)
    buckets = max(1, -(-size // BUCKET_BYTES))
    name = f"tessera_new_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"drop table if exists {name}")
    index.lists.repartition(buckets, "country", "key").write.mode("overwrite").bucketBy(buckets, "country", "key").sortBy("country", "key").option("path", f"{path}/lists").saveAsTable(name)
    spark.sql(f"drop table {name}")
    parts = [p for p in _PARTS if getattr(index, p) is not None]
    for p in parts:
        getattr(index, p).write.mode("overwrite").parquet(f"{path}/{p}")
    manifest = json.dumps({"about": about, "buckets": buckets, "bytes": size, "parts": parts})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return kept_index(spark, path, about)


def kept_index(spark: SparkSession, path: str, about: str) -> Index | None:
    """The index below ``path`` if it is whole and ``about`` the same, else None."""
    if not complete(spark, f"{path}/manifest"):
        return None
    m = json.loads(spark.read.parquet(f"{path}/manifest").first()[0])
    if m["about"] != about:
        return None
    return Index(lists=_table(spark, path, m["buckets"]), bytes=m["bytes"], **{p: spark.read.parquet(f"{path}/{p}") for p in m["parts"]})


def fingerprint(records: DataFrame) -> str:
    """Of the rows of a table, in any order."""
    n, total = records.agg(F.count("*"), F.sum(F.xxhash64(*sorted(records.columns)).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def _list_bytes() -> Column:
    return 8 * F.size("ids") + F.length("key") + 60


def _numbered(records: DataFrame, ordered: bool) -> tuple[DataFrame, DataFrame]:
    """(records whose id is a number, (num, id)). ``ordered``: numbers follow the ids."""
    rows = stored(placed(records).withColumnRenamed("pos", "num")) if ordered else stored(records.withColumn("num", F.monotonically_increasing_id()))
    return rows.drop("id").withColumnRenamed("num", "id"), rows.select("num", "id")


def _cap(fam: str, caps: dict) -> Column:
    out = F.lit(0)
    for f, cap in caps.items():
        out = F.when(F.col(fam) == f, cap).otherwise(out)
    return out


def small(rows: DataFrame, size: Column) -> DataFrame:
    """``rows``, to be broadcast if ``size``, summed over them, allows it."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else rows


def posting_lists(keys: DataFrame, caps: dict) -> DataFrame:
    """Posting lists of the keys (id, country, fam, key) that have no more records than their family's cap, stored.

    Keys above their cap are found by a count with a map-side part and leave before any are brought
    together, so no task gets the records of a hot key, and no list is longer than its cap.
    """
    keys = stored(keys.where(_cap("fam", caps) > 0))
    hot = stored(keys.groupBy("country", "fam", "key").agg(F.count("*").alias("df")).where(F.col("df") > _cap("fam", caps)).select("country", "fam", "key"))
    kept = keys.join(small(hot, F.length("key") + 40), ["country", "fam", "key"], "left_anti")
    return stored(kept.groupBy("country", "fam", "key").agg(F.collect_list("id").alias("ids")))


def _fam(keys: DataFrame) -> DataFrame:
    return keys.withColumn("fam", F.substring_index("key", ":", 1))


def build_index(reference: DataFrame, cfg: K.KeyConfig = K.KeyConfig()) -> Index:
    reference, names = _numbered(reference, True)
    vocab = stored(K.vocabulary(reference, X.split_words(F.col("addr_n"))))
    lists = posting_lists(_fam(K.all_keys(reference, vocab, cfg.pair_words_reference, cfg)), cfg.caps)
    return Index(lists, reference.groupBy("country").agg(F.count("*").alias("n1")), vocab, names)


def _met(index: Index, keys: DataFrame) -> DataFrame:
    """(q_id, fam, idf, ids): the posting list that a query key meets, at most one."""
    idf = F.log((F.col("n1") + 1) / F.size("ids")).alias("idf")
    lists = index.lists.join(F.broadcast(index.sizes), "country").select("country", "key", "fam", "ids", idf)
    lists = small(lists, _list_bytes()) if index.bytes is None else F.broadcast(lists) if index.bytes <= BROADCAST_BYTES else lists
    return keys.select(F.col("id").alias("q_id"), "country", "key").join(lists, ["country", "key"]).select("q_id", "fam", "idf", "ids")


def _probe(index: Index, keys: DataFrame) -> DataFrame:
    """(q_id, s1_id, fam, idf) of all meetings, dealt out by query. Lists are opened only then."""
    return _met(index, keys).repartition("q_id").select("q_id", "fam", "idf", F.explode("ids").alias("s1_id"))


#: Queries of a task that sums evidence; what a task holds does not grow with the input.
QUERIES_A_TASK = 10_000

@dataclass(frozen=True)
class Retrieval:
    """An index's families and their count columns, how many of a query's best pairs stay (None: all), and the names of its evidence."""

    families: dict[str, str]
    top: int | None
    n_keys: str
    score: str
    most: str
    member: str


def _evidence(names: DataFrame, met: list[DataFrame], ways: list[Retrieval]) -> DataFrame:
    """(q_id, s1_id, and for each way sum and maximum of idf, the number of keys and of each family's, and whether the pair is among its best).

    ``names`` has the queries (num, id), ``met`` each way's lists. Lists go to their query's task as they are, and are
    opened there, some queries at a time: a task holds a batch of opened lists, whatever it reads. Pairs rank by score
    rounded to 6 places, ties by s1_id. Evidence of a way without a limit is whole; with one, the first way's is of its best pairs alone.
    """
    schema = pa.schema([("q_id", pa.string()), ("s1_id", pa.int64())] + [(c, t) for w in ways for c, t in [(w.score, pa.float64()), (w.most, pa.float64()), (w.n_keys, pa.int64()), *[(f, pa.int64()) for f in w.families.values()], (w.member, pa.int32())]])
    codes = [(k, f) for k, w in enumerate(ways) for f in w.families]

    def opened(t: pa.Table) -> pa.RecordBatch:
        """All pairs of the queries of ``t``, rows in the order of queries."""
        named = t.filter(pc.is_valid(t["name"]))
        lists = t.filter(pc.is_valid(t["ids"])).combine_chunks()
        at = np.searchsorted(named["q_id"].to_numpy(), lists["q_id"].to_numpy())
        ids = lists["ids"].combine_chunks() if lists.num_rows else pa.array([], pa.list_(pa.int64()))
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        s1 = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
        if not len(s1):
            return pa.RecordBatch.from_pylist([], schema)
        order = np.lexsort((s1, at[row]))
        row, s1 = row[order], s1[order]
        q = at[row]
        first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (s1[1:] != s1[:-1])])
        idf, code = lists["idf"].to_numpy()[row], lists["code"].to_numpy()[row]
        q, s1 = q[first], s1[first]
        out, kept = {}, np.zeros(len(q), bool)
        for k, w in enumerate(ways):
            counts = {w.families[f]: np.add.reduceat((code == c).astype(np.int64), first) for c, (j, f) in enumerate(codes) if j == k}
            mine = np.isin(code, [c for c, (j, _) in enumerate(codes) if j == k])
            score, total = np.add.reduceat(np.where(mine, idf, 0.0), first), sum(counts.values())
            best = np.lexsort((s1, -np.round(score, 6), total == 0, q))
            begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.empty(len(q), np.int64)
            rank[best] = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
            member = (total > 0) & (rank < (len(q) if w.top is None else w.top))
            kept |= member
            out |= {w.score: score, w.most: np.maximum.reduceat(np.where(mine, idf, 0.0), first), w.n_keys: total, **counts, w.member: member.astype(np.int32)}
            if k == 0 and w.top is not None:
                out |= {c: np.where(member, out[c], 0) for c in (w.score, w.most, w.n_keys, *counts)}
        columns = [named["name"].take(pa.array(q[kept])).combine_chunks(), pa.array(s1[kept])]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(out[f.name][kept], f.type) for f in list(schema)[2:]]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            q = t["q_id"].to_numpy()
            whole = int(np.searchsorted(q, q[-1])) if len(q) else 0
            if whole:
                yield opened(t.slice(0, whole))
            rest = t.slice(whole)  # the rows of a query, at most one for each of its keys
        if rest is not None and rest.num_rows:
            yield opened(rest)

    each = names.select(F.col("num").alias("q_id"), F.col("id").alias("name"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("double").alias("idf"), F.lit(None).cast("array<bigint>").alias("ids"))
    for k, lists in enumerate(met):
        code = F.lit(0)
        for c, (j, f) in enumerate(codes):
            code = F.when(F.col("fam") == f, c).otherwise(code) if j == k else code
        each = each.unionByName(lists.select("q_id", F.lit(None).cast("string").alias("name"), code.alias("code"), "idf", "ids"))
    tasks = max(1, -(-names.count() // QUERIES_A_TASK))
    return each.repartition(tasks, "q_id").sortWithinPartitions("q_id").mapInArrow(run, from_arrow_schema(schema))


def _first(top: int | None) -> Retrieval:
    return Retrieval(FAMILIES, top, "n_keys", "score", "max_idf", "in_v1")


def _second(cfg: K.CorruptionConfig, top: int | None) -> Retrieval:
    return Retrieval({f: f"v2_k_{f}" for f in cfg.caps}, top, "v2_nkeys", "v2_score", "v2_max_idf", "in_v2")


def top_per_query(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Ranked by score rounded to 6 places, ties by s1_id, so that the order of additions cannot matter."""
    order = Window.partitionBy("q_id").orderBy(F.round(score, 6).desc(), "s1_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def query_candidates(index: Index, queries: DataFrame, top_k: int = 30, cfg: K.KeyConfig = K.KeyConfig()) -> DataFrame:
    queries, names = _numbered(queries, False)
    met = _met(index, K.all_keys(queries, index.vocab, cfg.pair_words, cfg))
    return _named(_evidence(names, [met], [_first(top_k)]).drop("in_v1"), index.names)


def generate_candidates(reference: DataFrame, queries: DataFrame, top_k: int = 30, cfg: K.KeyConfig = K.KeyConfig()) -> DataFrame:
    return query_candidates(build_index(reference, cfg), queries, top_k, cfg)


@dataclass
class CorruptionWords:
    """What the keys that undo corruptions are made with: vocabularies of names and of plain address words, and names' stop words by country."""

    names: DataFrame
    words: DataFrame
    stop: DataFrame
    sizes: DataFrame


def corruption_words(reference: DataFrame, cfg: K.CorruptionConfig = K.CorruptionConfig()) -> CorruptionWords:
    names = stored(K.vocabulary(reference, F.transform(X.split_words(F.col("name_n")), X.leet)))
    words = stored(K.vocabulary(reference, F.filter(X.split_words(F.col("addr_n")), lambda t: ~K.has_digit(t))))
    sizes = reference.groupBy("country").agg(F.count("*").alias("n1"))
    # at most 1 / stop_share words a record can be that frequent on average: a short list
    stop = names.join(F.broadcast(sizes), "country").where(F.col("df") >= cfg.stop_share * F.col("n1")).groupBy("country").agg(F.sort_array(F.collect_set("t")).alias("stop"))
    return CorruptionWords(names, words, stop, sizes)


def build_corruption_index(reference: DataFrame, cfg: K.CorruptionConfig = K.CorruptionConfig(), alias_table: DataFrame | None = None) -> Index:
    """With an alias table, names and addresses are first rewritten to their classes' spellings, as the queries are later."""
    classes = None if alias_table is None else stored(aliases.alias_classes(alias_table))
    reference, ids = _numbered(reference if classes is None else aliases.canonical(reference, classes), True)
    w = corruption_words(reference, cfg)
    lists = posting_lists(K.corruption_keys(reference, w.names, w.words, w.stop, True, cfg), cfg.caps)
    return Index(lists, w.sizes, w.names, ids, w.stop, w.words, classes)


def corruption_hits(index: Index, queries: DataFrame, cfg: K.CorruptionConfig = K.CorruptionConfig()) -> DataFrame:
    queries = queries if index.classes is None else aliases.canonical(queries, index.classes)
    queries, names = _numbered(queries, False)
    met = _met(index, K.corruption_keys(queries, index.vocab, index.words, index.stop, False, cfg))
    return _named(_evidence(names, [met], [_second(cfg, None)]).drop("in_v2"), index.names)


def query_union(first: Index, second: Index, queries: DataFrame, top_k: int = 30, second_k: int = 15, cfg: K.KeyConfig = K.KeyConfig(), corruption: K.CorruptionConfig = K.CorruptionConfig()) -> DataFrame:
    """``union_candidates`` of the ``top_k`` of one index and the ``second_k`` of the other, both of the same reference.

    The lists of both are dealt out together and once, so one pass over a query's lists has the evidence of both and their ranks.
    """
    queries, names = _numbered(queries, False)
    own = _met(first, K.all_keys(queries, first.vocab, cfg.pair_words, cfg))
    changed = queries if second.classes is None else aliases.canonical(queries, second.classes)
    more = _met(second, K.corruption_keys(changed, second.vocab, second.words, second.stop, False, corruption))
    return _named(_evidence(names, [own, more], [_first(top_k), _second(corruption, second_k)]), first.names)


def _named(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs with the reference's ids instead of numbers."""
    s = small(reference.select(F.col("num").alias("s1_id"), F.col("id").alias("_s")), F.length("_s") + 24)
    rest = [c for c in pairs.columns if c not in ("q_id", "s1_id")]
    return pairs.join(s, "s1_id").select("q_id", F.col("_s").alias("s1_id"), *rest)


def union_candidates(first: DataFrame, hits: DataFrame, top_k: int = 15) -> DataFrame:
    """Pairs of the first retrieval or among a query's ``top_k`` of the second, with the evidence of both, 0 where none."""
    second = top_per_query(hits.select("q_id", "s1_id", "v2_score"), "v2_score", top_k).select("q_id", "s1_id", F.lit(1).alias("in_v2"))
    both = first.withColumn("in_v1", F.lit(1)).join(hits.join(second, ["q_id", "s1_id"], "left"), ["q_id", "s1_id"], "full").na.fill(0)
    return both.where("in_v1 = 1 or in_v2 = 1")


def recall_report(candidates: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """For each country: true pairs, found pairs, recall, candidates a query, and what is missed, with its recall, of native names, domains and blank addresses."""
    hit = truth.join(candidates.select(F.col("q_id").alias("other"), F.col("s1_id").alias("s1"), F.lit(1).alias("hit")).distinct(), ["s1", "other"], "left")
    kinds = {"native": X.is_native(F.col("name_n")), "domain": F.col("is_domain"), "blank": F.col("addr_n") == ""}
    missed, got = F.col("hit").isNull(), F.col("hit").isNotNull().cast("double")
    aggs = [x for k in kinds for x in (F.count_if(missed & F.col(k)).alias(f"missed_{k}"), F.avg(F.when(F.col(k), got)).alias(f"recall_{k}"))]
    found = hit.join(queries.select(F.col("id").alias("other"), "country", *[c.alias(k) for k, c in kinds.items()]), "other").groupBy("country").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), *aggs)
    per = queries.select(F.col("id").alias("q_id"), "country").join(candidates.groupBy("q_id").agg(F.count("*").alias("n")), "q_id", "left").groupBy("country").agg(F.avg(F.coalesce("n", F.lit(0))).alias("per_query"))
    return found.join(per, "country").withColumn("recall", F.col("n_found") / F.col("n_true"))
