"""The second stage: its rows, its model, and decisions by it.

Entities are halved by hash. Half 0 learns and half 1 reports. Within half 0 the noisy-channel columns of a row come from tables
that have not seen the row's fold, and one fold of four ends training early; half 1 uses the tables of all of half 0.
A final fit takes all rows, each with the tables without its own fold, and as many rounds; what it keeps for new
records is the table of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import boosting, channel, decode, training
from tessera.operators.boosting import Boosted, Settings
from tessera.operators.features import FeatureSpec
from tessera.sources.records import bucket
from tessera.sources.stored import stored

#: No features: keys, texts, labels and how rows are dealt.
OTHERS = {"q_id", "s1_id", "country", "label", "true_s1", "half", "sub", "reads", "events", "r"}
HELD = 3
TAUS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9)


def labelled(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Second-stage rows with label, half and sub. A query without an owner goes with the entity it ranks first."""
    owner = truth.select(F.col("other").alias("q_id"), F.col("s1").alias("true_s1"))
    out = rows.join(owner, "q_id", "left").withColumn("label", F.coalesce((F.col("s1_id") == F.col("true_s1")).cast("int"), F.lit(0)))
    return training.halves(out)


def with_channel(rows: DataFrame, whole: bool = False) -> DataFrame:
    """``labelled`` rows with the cross-fitted channel columns; ``whole``: all rows learn, not half 0 alone.

    The rows are stored first: their labels and halves are shuffles that four steps here would make again.
    """
    rows = stored(rows)
    fit = F.lit(True) if whole else F.col("half") == 0
    return rows.join(channel.cross_fitted(rows.select("q_id", "s1_id", "label", "half", "sub", "events"), fit), ["q_id", "s1_id"])


def spec_of(rows: DataFrame, *drop: str) -> FeatureSpec:
    """All numeric columns; ``drop``: names, or beginnings with *, to leave out."""
    return FeatureSpec(tuple(c for c, t in rows.dtypes if c not in OTHERS and t != "string" and not t.startswith("array"))).drop(*drop)


@dataclass
class Evaluated:
    """The model of half 0 with its rounds, and ``scores``: (tau, f05) on half 1, tau null for the first stage's threshold."""

    model: Boosted
    scores: list[tuple[float | None, float]]

    @property
    def best(self) -> tuple[float, float]:
        return max((s for s in self.scores if s[0] is not None), key=lambda s: (s[1], -s[0]))


def evaluate(rows: DataFrame, entities: DataFrame, truth: DataFrame, settings: Settings = training.SECOND, drop: tuple[str, ...] = (), threshold: float = 0.7, taus: tuple[float, ...] = TAUS) -> Evaluated:
    """Fits half 0 of ``labelled`` rows and scores half 1 by macro F0.5; entities (id), truth (s1, other)."""
    rows = stored(with_channel(rows))
    spec = spec_of(rows, *drop)
    model = training.fit_matcher(rows.where("half = 0"), spec, settings, held=f"sub = {HELD}")
    judged = stored(model.transform(rows.where("half = 1"), "r").select("q_id", "s1_id", "p", "r"))
    mine = entities.select(F.col("id").alias("s1")).where(bucket(F.col("id"), 99, 2) == 1)
    own = truth.join(mine, "s1")
    spark = rows.sparkSession
    # one pass over all thresholds: a query's best pair, and from which taus on it is accepted
    best = lambda c: decode.decide(judged.withColumn("r", F.col(c)), 0.0).select("q_id", F.col("s1_id").alias("s1"), "r")
    grid = spark.createDataFrame([(t,) for t in taus], "tau double")
    got = best("r").crossJoin(F.broadcast(grid)).where("r >= tau").select("tau", "s1", F.col("q_id").alias("other"))
    got = got.unionByName(best("p").where(F.col("r") >= threshold).select(F.lit(-1.0).alias("tau"), "s1", F.col("q_id").alias("other")))
    every = mine.crossJoin(F.broadcast(grid.unionByName(spark.createDataFrame([(-1.0,)], "tau double"))))
    scores = decode.entity_scores(every.select(F.struct("tau", "s1").alias("s1"), "tau"), own.crossJoin(F.broadcast(grid.unionByName(spark.createDataFrame([(-1.0,)], "tau double")))).select(F.struct("tau", "s1").alias("s1"), "other"), got.join(mine, "s1", "left_semi").select(F.struct("tau", "s1").alias("s1"), "other"))
    found = scores.groupBy("tau").agg(F.avg("f").alias("f")).orderBy("tau").collect()
    return Evaluated(model, [(None if r["tau"] < 0 else r["tau"], r["f"]) for r in found])


def final(rows: DataFrame, rounds: int, settings: Settings = training.SECOND, drop: tuple[str, ...] = ()) -> tuple[Boosted, DataFrame]:
    """(model, channel table) of all ``labelled`` rows, for records that are not among them."""
    data = stored(with_channel(rows, whole=True))
    return boosting.fit(data, spec_of(data, *drop).names, replace(settings, rounds=rounds)), channel.llr_table(rows)


def scored(rows: DataFrame, model: Boosted, table: DataFrame) -> DataFrame:
    """Second-stage rows with r, by a final model and its channel table."""
    return model.transform(rows.join(channel.channel_features(rows, table), ["q_id", "s1_id"]), "r")
