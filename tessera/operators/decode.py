"""From scores to lists: acceptance, expected-score decoding, assembly, metrics, checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.records import bucket

#: Most candidates of an entity, support of the Poisson part, least r.
MOST, SUPPORT, LEAST_R = 10, 6, 0.02


def accept(best: DataFrame, threshold: float, gap: float = 0.0) -> DataFrame:
    return best.where((F.col("p1") >= threshold) & (F.col("p1") - F.col("p2") >= gap))


def entity_guard(accepted: DataFrame, guard: float) -> DataFrame:
    """Only entities with an accepted record of at least ``guard``."""
    return accepted.join(accepted.where(F.col("p1") >= guard).select("s1_id").distinct(), "s1_id", "left_semi")


def decide(rows: DataFrame, tau: float, unseen_tau: float | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The best r of each query if it reaches tau; queries of countries not in ``seen`` (country) need ``unseen_tau``."""
    best = rows.groupBy("q_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "q_id"]), F.struct("r", F.xxhash64("s1_id"))).alias("x")).select("q_id", "x.*")
    if unseen_tau is None or seen is None:
        return best.where(F.col("r") >= tau)
    known = seen.select("country", F.lit(True).alias("_seen")).distinct()
    return best.join(F.broadcast(known), "country", "left").where(F.col("r") >= F.when(F.col("_seen"), tau).otherwise(unseen_tau)).drop("_seen")


def discounted(rows: DataFrame, seen: DataFrame, factor: float, column: str = "r") -> DataFrame:
    """``column`` times ``factor`` where country is not in ``seen`` (country)."""
    if factor == 1.0:
        return rows
    known = seen.select("country", F.lit(True).alias("_seen")).distinct()
    return rows.join(F.broadcast(known), "country", "left").withColumn(column, F.when(F.col("_seen"), F.col(column)).otherwise(F.col(column) * factor)).drop("_seen")


def best_count(r: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """For each row of r (descending, 0: none) and expected unseen matches mu, the k in 0..MOST with the best expected F0.5, the smaller of equals.

    A match count is the sum of the rows' events, k of them predicted, and a Poisson number of unseen ones,
    the tail folded into its last value.
    """
    e = len(r)
    tail = np.zeros((e, SUPPORT))
    tail[:, 0] = np.exp(-mu)
    for j in range(1, SUPPORT):
        tail[:, j] = tail[:, j - 1] * mu / j
    tail[:, -1] += np.maximum(1 - tail.sum(1), 0)
    width = MOST + SUPPORT
    behind = np.zeros((MOST + 1, e, width))  # matches among what is not predicted
    behind[MOST, :, :SUPPORT] = tail
    for k in range(MOST - 1, -1, -1):
        x = r[:, k : k + 1]
        behind[k] = behind[k + 1] * (1 - x)
        behind[k, :, 1:] += behind[k + 1, :, :-1] * x
    score = np.zeros((MOST + 1, e))
    score[0] = behind[0, :, 0]
    ahead = np.zeros((e, MOST + 1))
    ahead[:, 0] = 1
    for k in range(1, MOST + 1):
        x = r[:, k - 1 : k]
        new = ahead * (1 - x)
        new[:, 1:] += ahead[:, :-1] * x
        ahead = new
        for tp in range(1, k + 1):
            total = tp + np.arange(width)
            f = 1.25 * tp / (0.25 * total + k)
            score[k] += ahead[:, tp] * (behind[k] @ f)
        score[k] = np.where(r[:, k - 1] > 0, score[k], -1)
    return np.argmax(np.round(score, 12), axis=0)


def expected_decode(rows: DataFrame, mass: DataFrame | None = None, mu0: float = 0.02) -> DataFrame:
    """(q_id, s1_id) accepted: of each entity's records by r, the first k of best expected F0.5."""
    first = rows.where(F.col("r") >= LEAST_R).withColumn("_k", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("r"), "q_id"))).where(F.col("_k") <= MOST)
    lists = first.groupBy("s1_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("r"), "q_id"))).alias("x"))
    lists = lists.join(mass, "s1_id", "left") if mass is not None else lists.withColumn("mass", F.lit(0.0))

    @F.pandas_udf(T.IntegerType())
    def count(r: pd.Series, mu: pd.Series) -> pd.Series:
        return pd.Series(best_count(np.stack(r) if len(r) else np.zeros((0, MOST)), mu.to_numpy()).astype(np.int32))

    padded = F.slice(F.concat(F.transform("x.r", lambda r: -r), F.array_repeat(F.lit(0.0), MOST)), 1, MOST)
    k = count(padded, F.coalesce("mass", F.lit(0.0)) + F.lit(mu0))
    return lists.withColumn("k", k).where("k > 0").select("s1_id", F.explode(F.slice("x.q_id", F.lit(1), F.col("k"))).alias("q_id"))


def assemble(entities: DataFrame, accepted: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, list, pos): every entity (id, pos), its accepted records sorted and joined, '' for none."""
    lists = accepted.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("q_id")), ",").alias(column))
    return entities.join(lists, entities["id"] == lists["s1_id"], "left").select(F.col("id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column), "pos")


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1, n_true, n_pred, tp, f, further columns of ``entities``); entities (s1), truth and predicted (s1, other)."""
    truth, predicted = truth.select("s1", "other").distinct(), predicted.select("s1", "other").distinct()
    n = lambda d, c: d.groupBy("s1").agg(F.count("*").alias(c))
    t = entities.join(n(truth, "n_true"), "s1", "left").join(n(predicted, "n_pred"), "s1", "left").join(n(truth.join(predicted, ["s1", "other"]), "tp"), "s1", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return t.withColumn("f", _f05())


def _f05() -> Column:
    precision, recall = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    return F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).when(F.col("tp") == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def macro_f05(scores: DataFrame, *by: str) -> DataFrame:
    """Means over entities, for each value of ``by`` and in all (rollup)."""
    single = F.col("n_true") == 0
    aggs = [
        F.count("*").alias("entities"), F.avg("f").alias("macro_f05"), F.avg(F.when(single, F.col("f"))).alias("singleton_f"), F.avg(F.when(~single, F.col("f"))).alias("matched_f"),
        F.avg(F.when(~single & (F.col("n_pred") > 0), F.col("tp") / F.col("n_pred"))).alias("matched_precision"), F.avg((F.col("n_pred") > 0).cast("double")).alias("predicted_share"), F.avg(F.when(~single, F.col("tp") / F.col("n_true"))).alias("matched_recall"),
    ]
    return (scores.rollup(*by) if by else scores.groupBy()).agg(*aggs)


def threshold_grid(best: DataFrame, truth: DataFrame, thresholds: list[float], gaps: list[float]) -> DataFrame:
    """Record-level precision, recall and F0.5 for every threshold and gap, in one aggregate; the grid is as small as its arguments."""
    spark = best.sparkSession
    grid = spark.createDataFrame([(t, g) for t in thresholds for g in gaps], "threshold double, gap double")
    owner = truth.select(F.col("other").alias("q_id"), F.col("s1").alias("owner"))
    rows = best.join(owner, "q_id", "left").crossJoin(F.broadcast(grid))
    yes = (F.col("p1") >= F.col("threshold")) & (F.col("p1") - F.col("p2") >= F.col("gap"))
    agg = rows.groupBy("threshold", "gap").agg(F.count_if(yes).alias("n_pred"), F.count_if(yes & (F.col("s1_id") == F.col("owner"))).alias("tp"), F.count("owner").alias("n_true"))
    p, r = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    return agg.withColumns({"precision": F.when(F.col("n_pred") > 0, p), "recall": F.when(F.col("n_true") > 0, r)}).withColumn("f05", F.when(F.col("tp") > 0, 1.25 * F.col("precision") * F.col("recall") / (0.25 * F.col("precision") + F.col("recall"))).otherwise(0.0))


def tuned(best: DataFrame, entities: DataFrame, truth: DataFrame, thresholds: list[float], gaps: list[float], guards: list[float]) -> DataFrame:
    """(threshold, gap, guard, half, f05): macro F0.5 of every setting on both halves of the entities (s1), by hash; one pass over all settings.

    A guard of 0 guards nothing; other guards ask for a threshold below them. Choose on half 0, report on half 1.
    """
    settings = [(t, g, u) for t in thresholds for g in gaps for u in guards if not u or u > t]
    grid = best.sparkSession.createDataFrame(settings, "threshold double, gap double, guard double")
    by = ["threshold", "gap", "guard", "s1"]
    owner = truth.select(F.col("other").alias("q_id"), F.col("s1").alias("s1_id"), F.lit(1).alias("hit")).distinct()
    rows = best.join(owner, ["q_id", "s1_id"], "left").crossJoin(F.broadcast(grid)).where((F.col("p1") >= F.col("threshold")) & (F.col("p1") - F.col("p2") >= F.col("gap")))
    got = rows.withColumnRenamed("s1_id", "s1").groupBy(*by).agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"), F.max("p1").alias("top")).where(F.col("top") >= F.col("guard"))
    own = entities.select("s1").join(truth.groupBy("s1").agg(F.countDistinct("other").alias("n_true")), "s1", "left").crossJoin(F.broadcast(grid)).join(got, by, "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return own.withColumns({"f": _f05(), "half": bucket(F.col("s1"), 99, 2)}).groupBy("threshold", "gap", "guard", "half").agg(F.avg("f").alias("f05"))


def best_threshold(grid: DataFrame, least: float = 0.0) -> DataFrame:
    """The cell of best f05, if it beats ``least``."""
    return grid.agg(F.max_by(F.struct("threshold", "gap", "f05"), F.struct("f05", -F.col("threshold"), -F.col("gap"))).alias("x")).select("x.*").where(F.col("f05") > least)


def diagnostics(best: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """For each country: queries, accepted share, share with p1 of 0.9 or more, share of entities without a record. entities has s1_id, country."""
    rows = best.join(entities, "s1_id")
    per = rows.groupBy("country").agg(F.count("*").alias("queries"), F.avg((F.col("p1") >= threshold).cast("double")).alias("accepted"), F.avg((F.col("p1") >= 0.9).cast("double")).alias("sure"))
    got = accept(best, threshold).select("s1_id").distinct().withColumn("_got", F.lit(1))
    empty = entities.join(got, "s1_id", "left").groupBy("country").agg(F.avg(F.col("_got").isNull().cast("double")).alias("empty_lists"))
    return empty.join(per, "country", "left")


def violations(lists: DataFrame, entities: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, column: str = "matched_entity_ids") -> DataFrame:
    """(rule, id) of everything wrong with lists (source1_entity_id, ``column``) for entities (id); if both have pos, of rows out of order too."""
    own = lists.select(F.col("source1_entity_id").alias("s1"), F.col(column).alias("ids"))
    each = own.where("ids <> ''").select("s1", F.explode(F.split("ids", ",")).alias("id"))
    rule = lambda name, df, c: df.select(F.lit(name).alias("rule"), F.col(c).alias("id"))
    found = [
        rule("duplicate_row", own.groupBy("s1").count().where("count > 1"), "s1"),
        rule("duplicate_id", each.groupBy("s1", "id").count().where("count > 1").select("s1").distinct(), "s1"),
        rule("blank_id", each.where(F.trim("id") == "").select("s1").distinct(), "s1"),
        rule("self_match", each.where(F.col("id").startswith("S1-")), "id"),
        rule("wrong_prefix", each.where((F.trim("id") != "") & ~F.col("id").rlike("^S[123]-")), "id"),
        rule("missing_entity", entities.select("id").join(own, F.col("id") == F.col("s1"), "left_anti"), "id"),
        rule("extra_entity", own.join(entities.select("id"), F.col("s1") == F.col("id"), "left_anti"), "s1"),
        rule("quote", own.where(F.col("ids").contains('"')), "s1"),
        rule("matched_twice", each.groupBy("id").agg(F.countDistinct("s1").alias("n")).where("n > 1"), "id"),
    ]
    if "pos" in lists.columns and "pos" in entities.columns:
        placed = lists.select(F.col("source1_entity_id").alias("s1"), F.col("pos").alias("at")).join(entities.select("id", "pos"), F.col("s1") == F.col("id"))
        found.append(rule("out_of_order", placed.where("at <> pos"), "s1"))
    if known is not None:
        found.append(rule("unknown_id", each.join(known.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti"), "id"))
    if candidates is not None:
        found.append(rule("warning_not_a_candidate", each.join(candidates.select(F.col("s1_id").alias("s1"), F.col("q_id").alias("id")), ["s1", "id"], "left_anti"), "id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
