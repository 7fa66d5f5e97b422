"""Training pairs, folds, samples, worlds, and models."""

from __future__ import annotations

import hashlib
from dataclasses import replace
from pathlib import PurePosixPath

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.boosting import Boosted, Settings
from tessera.operators.features import FeatureSpec
from tessera.sources.records import bucket

FOLDS = 5
KEEP_P = 0.02


def group_folds(rows: DataFrame, group: str = "grp", seed: int = 13, k: int = FOLDS) -> DataFrame:
    """All rows of a group get one fold."""
    return rows.withColumn("fold", bucket(F.col(group), seed, k))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all, if there are fewer), those first by a hash of the key."""
    return rows.withColumn("_h", F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")


def world_split(entities: DataFrame, records: DataFrame, orphans_per_entity: float = 5.8) -> DataFrame:
    """(id, world, kind): entities halved by hash; records go with their owner, the rest by hash, as long as a world has at most so many records an entity."""
    world = lambda c: F.when(bucket(c, 21, 2) == 0, "A").otherwise("B")
    own = entities.select("id", "country", world(F.col("id")).alias("world"))
    owned = records.where("owner is not null").join(own.select(F.col("id").alias("owner"), "world"), "owner").select("id", "country", "world", F.lit("owned").alias("kind"))
    free = records.where("owner is null").select("id", "country", world(F.col("id")).alias("world"))
    size = own.groupBy("world", "country").agg(F.count("*").alias("n"))
    taken = owned.groupBy("world", "country").agg(F.count("*").alias("taken"))
    room = size.join(taken, ["world", "country"], "left").withColumn("room", orphans_per_entity * F.col("n") - F.coalesce("taken", F.lit(0)))
    # ranks within 256 stretches of the hash, behind the counts of the stretches before: no task ranks a whole world
    h = F.md5(F.concat("id", F.lit(":22")).cast("binary"))
    free = free.withColumns({"h": h, "part": F.substring(h, 1, 2)})
    before = free.groupBy("world", "country", "part").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("world", "country").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    free = free.withColumn("r", F.row_number().over(Window.partitionBy("world", "country", "part").orderBy("h", "id"))).join(F.broadcast(before), ["world", "country", "part"]).join(F.broadcast(room), ["world", "country"])
    free = free.where(F.col("before") + F.col("r") <= F.col("room")).select("id", "country", "world", F.lit("orphan").alias("kind"))
    return own.select("id", "country", "world", F.lit("entity").alias("kind")).unionByName(owned).unionByName(free)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label (1: the query's owner) and fold by owner, else by query."""
    t = truth.select(F.col("other").alias("q_id"), F.col("s1").alias("true_s1"))
    out = pairs.join(t, "q_id", "left").withColumn("label", F.coalesce((F.col("s1_id") == F.col("true_s1")).cast("int"), F.lit(0)))
    return group_folds(out.withColumn("grp", F.coalesce("true_s1", "q_id"))).drop("grp")


def halves(rows: DataFrame) -> DataFrame:
    """half 0 or 1 and sub 0..3 by owner, else by the query's best candidate; reads: whether a reader of pairs learns from it. Needs q_rank and true_s1."""
    first = F.first(F.when(F.col("q_rank") == 0, F.col("s1_id")), ignorenulls=True).over(Window.partitionBy("q_id"))
    out = rows.withColumn("grp", F.coalesce("true_s1", first))
    return out.withColumns({"half": bucket(F.col("grp"), 99, 2), "sub": bucket(F.col("grp"), 5, 4), "reads": _reads("grp")}).drop("grp")


def reader_rows(rows: DataFrame, group: str = "grp") -> DataFrame:
    """The rows that a reader of pairs learns from: a third of half 0. The second stage leaves them out, so none of its rows has a score fitted on its own label."""
    return rows.where(_reads(group))


def _reads(group: str) -> Column:
    return (bucket(F.col(group), 77, 3) == 0) & (bucket(F.col(group), 99, 2) == 0)


def cache_path(root: str, country: str, n: int, seed: int, alias_mode: str, blocking: str, settings: str = "") -> str:
    """Where a pair table is kept; ``settings`` says what else it depends on and goes in as a hash."""
    mark = hashlib.sha256(settings.encode()).hexdigest()[:12]
    return str(PurePosixPath(root) / f"pairs_{country}_{n}_{seed}_{alias_mode}_{blocking}_{mark}")


#: Of the matcher, the context model, the calibrators and the second stage.
MATCHER = Settings(rounds=400, leaves=255, rate=0.08, least_rows=200, row_share=0.8, feature_share=0.8, patience=30)
CONTEXT_TREES = Settings(rounds=300, leaves=63, rate=0.05, least_rows=300, l2=0.0, feature_share=0.9, patience=300)
CALIBRATOR = Settings(rounds=200, leaves=15, rate=0.05, least_rows=500, l2=0.0)
SECOND = Settings(rounds=2000, leaves=255, rate=0.05, least_rows=200, row_share=0.8, feature_share=0.7, patience=50)


def fit_matcher(rows: DataFrame, spec: FeatureSpec, settings: Settings = MATCHER, held: str = "fold = 0", refit: bool = False) -> Boosted:
    """Gradient-boosted trees on label. Rows where ``held`` is true are for validation: they are not learnt, and rounds end when they gain nothing.

    ``refit`` learns again from all rows, with as many rounds as the first fit kept.
    """
    rows = rows.withColumn("_held", F.expr(held))
    model = boosting.fit(rows, spec.names, settings, held="_held")
    return boosting.fit(rows, spec.names, replace(settings, rounds=len(model.trees))) if refit else model


def save_model(model: Boosted, path: str) -> None:
    """The model as one row of text; it holds the columns it takes, in order."""
    SparkSession.active().createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(path: str) -> Boosted:
    return Boosted.from_json(SparkSession.active().read.parquet(path).first()[0])


def predict(model: Boosted, rows: DataFrame, keep: float = KEEP_P) -> DataFrame:
    """Rows with p (float), those of at least ``keep``."""
    out = model.transform(rows.drop("p") if "p" not in model.names else rows, "_p").withColumn("_p", F.col("_p").cast("float"))
    return out.where(F.col("_p") >= F.lit(keep).cast("float")).select(*[c for c in rows.columns if c != "p"], F.col("_p").alias("p"))


#: What the context model reads of a query's best pair (context.context_features).
CONTEXT = FeatureSpec(("p1", "p2", "gap", "e_strong", "e_strong_s2", "e_strong_s3", "e_mid", "e_max", "e_sum", "leak", "n_src", "src3"))


def fit_context_model(best: DataFrame, truth: DataFrame, settings: Settings = CONTEXT_TREES) -> Boosted:
    """Trees on a query's own evidence and its entity's context; the label is whether the best entity owns the query. truth: (s1, other)."""
    owner = truth.select(F.col("other").alias("q_id"), F.col("s1").alias("owner"))
    rows = best.join(owner, "q_id", "left").withColumn("label", F.coalesce((F.col("s1_id") == F.col("owner")).cast("int"), F.lit(0)))
    return boosting.fit(rows, CONTEXT.names, settings)


def apply_context_model(model: Boosted, best: DataFrame) -> DataFrame:
    """``best`` with r: how likely its best entity owns the query."""
    return model.transform(best, "r")


def fit_calibrators(best: DataFrame, settings: Settings = CALIBRATOR) -> tuple[Boosted, Boosted]:
    """How likely the best is the owner, by p1 and p2, rising in p1 and falling in p2; and the second, the other way round, where there is one. Needs label, label2."""
    first = boosting.fit(best, ("p1", "p2"), replace(settings, monotone={"p1": 1, "p2": -1}))
    return first, boosting.fit(best.where("s1_id2 is not null"), ("p1", "p2"), replace(settings, monotone={"p1": -1, "p2": 1}), label="label2")


def apply_calibrators(models: tuple[Boosted, Boosted], best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q_id, s1_id, r) and (s1_id, mass): the runner-up mass of each entity."""
    second = models[1].transform(best.where("s1_id2 is not null"), "r").groupBy(F.col("s1_id2").alias("s1_id")).agg(F.sum("r").alias("mass"))
    return models[0].transform(best, "r").select("q_id", "s1_id", "r"), second


def pair_quality(scored: DataFrame, column: str = "p") -> dict[str, float]:
    """Area under the curve and clipped log-loss of scored pairs with labels."""
    p = F.greatest(F.least(F.col(column).cast("double"), F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
    auc = BinaryClassificationEvaluator(rawPredictionCol="x").evaluate(scored.select(F.col("label").cast("double").alias("label"), F.col(column).cast("double").alias("x")))
    return {"auc": auc, "log_loss": loss}


def summed_logits(scored: DataFrame, *columns: str) -> DataFrame:
    """``combined``: the probability at the sum of the columns' logits, as if they were independent."""
    clipped = [F.greatest(F.least(F.col(c).cast("double"), F.lit(1 - 1e-6)), F.lit(1e-6)) for c in columns]
    total = sum((F.log(p / (1 - p)) for p in clipped), F.lit(0.0))
    return scored.withColumn("combined", 1 / (1 + F.exp(-total)))


def _read(rows: DataFrame) -> DataFrame:
    """``grams``: the trigrams and words of both texts (text1, text2), marked as shared, only left or only right."""
    words = lambda c: F.split(F.lower(c), " ")
    padded = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    trigrams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(padded(c), i, F.lit(3)))
    every = lambda c: F.array_distinct(F.concat(words(c), trigrams(c)))
    left, right = every(F.coalesce("text1", F.lit(""))), every(F.coalesce("text2", F.lit("")))
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    return rows.withColumn("grams", F.concat(tagged("=", F.array_intersect(left, right)), tagged("-", F.array_except(left, right)), tagged("+", F.array_except(right, left))))


def fit_reader(rows: DataFrame, width: int = 1 << 18) -> PipelineModel:
    """A reader of hard pairs that sees both texts at once (text1, text2, label): a logistic model on what they share and what each has alone."""
    return Pipeline(stages=[HashingTF(inputCol="grams", outputCol="features", numFeatures=width, binary=True), LogisticRegression(maxIter=40, regParam=0.001)]).fit(_read(rows).select("grams", "label"))


def score_pairs(rows: DataFrame, reader: PipelineModel, hard: float = 0.98) -> DataFrame:
    """``ce``, the reader's probability, for the pairs of p up to ``hard``; the others keep p."""
    tough = reader.transform(_read(rows.where(F.col("p") <= hard))).withColumn("ce", vector_to_array(F.col("probability"))[1])
    return tough.select(*rows.columns, "ce").unionByName(rows.where(F.col("p") > hard).withColumn("ce", F.col("p").cast("double")))
