"""Whole plans: scoring of all countries in one job, the second stage, decoding to files."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aliases, blocking, channel, context, decode, training
from tessera.operators import features as feats
from tessera.operators.boosting import Boosted
from tessera.operators.keys import CorruptionConfig, KeyConfig
from tessera.sources.records import bucket
from tessera.sources.stored import cached, complete, stored


@dataclass(frozen=True)
class PlanConfig:
    """blocking is "v1" (keys) or "v2" (keys and corruption-undoing keys)."""

    blocking: str = "v1"
    alias_mode: str = "native"
    top_k: int = 30
    keys: KeyConfig = field(default_factory=KeyConfig)
    corruption: CorruptionConfig = field(default_factory=CorruptionConfig)


@dataclass
class Indexes:
    """What queries are blocked against; ``second`` only for blocking v2."""

    first: blocking.Index
    second: blocking.Index | None = None


def indexes(reference: DataFrame, cfg: PlanConfig = PlanConfig(), alias_table: DataFrame | None = None, keep: str | None = None) -> Indexes:
    """Builds the indexes of a reference. With ``keep``, a folder, they outlive the run: the same reference and configuration find them there."""
    tables = alias_table if cfg.blocking == "v2" else None

    def one(name: str, build) -> blocking.Index:
        if keep is None:
            return build()
        about = f"{name} {blocking.fingerprint(reference)} {cfg.keys if name == 'first' else cfg.corruption} {'' if tables is None else blocking.fingerprint(tables)}"
        return blocking.kept_index(reference.sparkSession, f"{keep}/{name}", about) or blocking.keep_index(build(), f"{keep}/{name}", about)

    first = one("first", lambda: blocking.build_index(reference, cfg.keys))
    return Indexes(first, one("second", lambda: blocking.build_corruption_index(reference, cfg.corruption, alias_table)) if cfg.blocking == "v2" else None)


def candidates(reference: DataFrame, queries: DataFrame, cfg: PlanConfig = PlanConfig(), alias_table: DataFrame | None = None, index: Indexes | None = None) -> DataFrame:
    index = index or indexes(reference, cfg, alias_table)
    if index.second is None:
        return blocking.query_candidates(index.first, queries, cfg.top_k, cfg.keys)
    return blocking.query_union(index.first, index.second, queries, cfg.top_k, cfg=cfg.keys, corruption=cfg.corruption)


def build_pair_table(reference: DataFrame, queries: DataFrame, truth: DataFrame, n: int, seed: int = 7, alias_table: DataFrame | None = None, cfg: PlanConfig = PlanConfig()) -> tuple[DataFrame, DataFrame]:
    """(pairs, meta) of a sample of n queries against the whole reference; meta has each query's owner, fold and country."""
    q = stored(training.sample(queries, "id", n, seed))
    t = truth.select(F.col("other").alias("q_id"), F.col("s1").alias("true_s1"))
    meta = q.select(F.col("id").alias("q_id"), "country").join(t, "q_id", "left")
    meta = training.group_folds(meta.withColumn("grp", F.coalesce("true_s1", "q_id"))).drop("grp")
    return pair_table(reference, q, truth, alias_table, cfg), meta


def _cache(root: str, n: int, seed: int, cfg: PlanConfig) -> str:
    return training.cache_path(root, "all", n, seed, cfg.alias_mode, cfg.blocking, repr(cfg))


def cached_pair_table(spark: SparkSession, root: str, reference: DataFrame, queries: DataFrame, truth: DataFrame, n: int, seed: int = 7, alias_table: DataFrame | None = None, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """The pairs of ``build_pair_table``, kept below ``root`` under sample, seed and configuration; the meta table lies beside them."""
    path = _cache(root, n, seed, cfg)

    def build() -> DataFrame:
        rows, meta = build_pair_table(reference, queries, truth, n, seed, alias_table, cfg)
        meta.write.mode("overwrite").parquet(path.replace("pairs_", "meta_"))
        return rows

    return cached(spark, path, build)


def meta_table(spark: SparkSession, root: str, n: int, seed: int = 7, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Owner, fold and country of the queries of ``cached_pair_table``."""
    return spark.read.parquet(_cache(root, n, seed, cfg).replace("pairs_", "meta_"))


def pair_table(reference: DataFrame, queries: DataFrame, truth: DataFrame, alias_table: DataFrame | None = None, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Training rows: candidates, features, label and fold."""
    q = aliases.prepared(queries, alias_table, cfg.alias_mode)
    return training.labelled(feats.pair_features(candidates(reference, q, cfg, alias_table), reference, q), truth)


def score(reference: DataFrame, queries: DataFrame, model: Boosted, alias_table: DataFrame | None = None, cfg: PlanConfig = PlanConfig(), index: Indexes | None = None) -> DataFrame:
    """Scored pairs (q_id, s1_id, p), lazily, for all countries."""
    q = aliases.prepared(queries, alias_table, cfg.alias_mode)
    rows = feats.pair_features(candidates(reference, q, cfg, alias_table, index), reference, q)
    return training.predict(model, rows).select("q_id", "s1_id", "p")


def score_in_chunks(reference: DataFrame, queries: DataFrame, model: Boosted, path: str, chunks: int, alias_table: DataFrame | None = None, cfg: PlanConfig = PlanConfig(), keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, queries without one), in ``chunks`` parts of the queries that are written one after the other below ``path``.

    Parts that are there as a whole stay, so a run that was killed goes on where it was. What the scores depend on is part of their place.
    """
    spark = reference.sparkSession
    about = [blocking.fingerprint(reference), blocking.fingerprint(queries), model.to_json(), repr(cfg), "" if alias_table is None else blocking.fingerprint(alias_table), str(chunks)]
    at = f"{path}/{hashlib.sha256(chr(10).join(about).encode()).hexdigest()[:16]}"
    index = None
    for k in range(chunks):
        pairs, alone = f"{at}/pairs/chunk={k}", f"{at}/alone/chunk={k}"
        own = queries.where(bucket(F.col("id"), 31, chunks) == k)
        if not complete(spark, pairs):
            index = index or indexes(reference, cfg, alias_table, keep)
            score(reference, own, model, alias_table, cfg, index).write.mode("overwrite").parquet(pairs)
        if not complete(spark, alone):
            own.select(F.col("id").alias("q_id")).join(spark.read.parquet(pairs), "q_id", "left_anti").write.mode("overwrite").parquet(alone)
    return spark.read.parquet(f"{at}/pairs").drop("chunk"), spark.read.parquet(f"{at}/alone").drop("chunk")


def second_stage(scored: DataFrame, reference: DataFrame, queries: DataFrame, siblings: bool = True) -> DataFrame:
    """Rows of the second model: context, text and vocabulary features, house numbers, siblings, channel events.

    What later steps read several times is stored, since a plan would make it anew for each of them.
    """
    if siblings:
        scored = context.add_sibling_candidates(scored, stored(context.sibling_candidates(scored, queries)))
    ranked = stored(context.query_context(scored))
    base = stored(feats.with_texts(context.entity_context(ranked), reference, queries))
    t = feats.leftover_features(base)
    for f in (feats.rest_features, feats.token_features, feats.number_features, feats.flag_features, feats.kernel_features, feats.house_number_relations):
        t = f(t)
    t = channel.with_events(t)
    t = t.join(feats.vocab_features(base, reference).select("q_id", "s1_id", "v_min", "v_max", "v_unknown", "v_known"), ["q_id", "s1_id"])
    return t.join(context.sibling_features(base, reference), ["q_id", "s1_id"]) if siblings else t


def submit(entities: DataFrame, accepted: DataFrame, path: str, candidates: DataFrame | None = None, candidate_path: str = "") -> DataFrame:
    """Writes the lists, and those of the candidates (q_id, s1_id) if given; returns what is wrong with them."""
    from tessera.sources.records import write_lists

    lists = decode.assemble(entities, accepted)
    write_lists(lists, path)
    if candidates is not None:
        write_lists(decode.assemble(entities, candidates, "candidate_entity_ids"), candidate_path)
    return decode.violations(lists, entities, candidates=candidates)
