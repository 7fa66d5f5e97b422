"""The steps of a linkage run, each from files to files: ``python -m tessera STEP --root DATA --work WORK ...``."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aliases, context, decode, training
from tessera.operators import features as feats
from tessera.plans import linkage, rerank
from tessera.sources import records as R
from tessera.sources.gate import beats
from tessera.sources.snapshot import snapshot


class Run:
    """Where a run's tables are."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.cfg = linkage.PlanConfig(blocking=args.blocking, alias_mode=args.alias_mode, top_k=args.top_k)

    def feed(self, split: str, *sources: int) -> DataFrame:
        tables = [R.load_normalized(self.spark, lambda k=k: R.read_tsv(self.spark, R.raw_path(self.args.root, split, k)), f"{self.args.work}/normalized_{split}_{k}") for k in sources]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def truth(self) -> DataFrame:
        return R.truth_pairs(R.read_tsv(self.spark, R.raw_path(self.args.root, "train", None), R.TRUTH))

    def alias_table(self) -> DataFrame | None:
        return None if self.args.alias_mode == "none" else self.spark.read.parquet(f"{self.args.work}/aliases")

    def normalize(self) -> None:
        for split in self.args.splits.split(","):
            self.feed(split, 1, 2, 3).count()

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.args.work}/{name}")

    def save(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.args.work}/{name}")

    def note(self, name: str, values: dict) -> None:
        self.save(self.spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1), name)
        print(json.dumps(values))

    def noted(self, name: str) -> dict:
        return json.loads(self.stored(name).first()[0])

    def settings(self, s):
        """Of a model, with the rounds and leaves of the command line where given."""
        return replace(s, **{k: v for k, v in (("rounds", self.args.rounds), ("leaves", self.args.leaves), ("least_rows", self.args.least_rows), ("rate", self.args.rate)) if v})

    def fit_aliases(self) -> None:
        """From a sample of the pairs of folds 1 to 4, so that validation does not see aliases of its own."""
        truth = self.truth().select(F.col("s1").alias("s1_id"), F.col("other").alias("q_id"))
        learnt = training.group_folds(truth, "s1_id").where("fold <> 0").drop("fold")
        pairs = feats.with_texts(training.sample(learnt, "q_id", self.args.alias_sample, 3), self.feed("train", 1), self.feed("train", 2, 3))
        self.save(aliases.fit_aliases(pairs), "aliases")

    def train(self) -> None:
        """Two matchers: one that has not learnt fold 0, for the scores of the training split, and one of all folds."""
        rows = linkage.cached_pair_table(self.spark, self.args.work, self.feed("train", 1), self.feed("train", 2, 3), self.truth(), self.args.sample, self.args.seed, self.alias_table(), self.cfg)
        spec, s = feats.FeatureSpec.of(rows), self.settings(training.MATCHER)
        model = training.fit_matcher(rows, spec, s)
        training.save_model(model, f"{self.args.work}/matcher")
        training.save_model(training.fit_matcher(rows, spec, replace(s, rounds=max(1, len(model.trees))), held="false"), f"{self.args.work}/matcher_final")

    def score(self) -> None:
        model = training.load_model(f"{self.args.work}/matcher" + ("" if self.args.split == "train" else "_final"))
        work, split = self.args.work, self.args.split
        scored, alone = linkage.score_in_chunks(self.feed(split, 1), self.feed(split, 2, 3), model, f"{work}/chunks_{split}", self.args.chunks, self.alias_table(), self.cfg, f"{work}/index_{split}")
        self.save(scored, f"scored_{split}")
        self.save(alone, f"alone_{split}")

    def unseen_scores(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(best pairs of the queries that the matcher has not learnt, entities of fold 0, their truth): whose queries it has not learnt either."""
        meta = linkage.meta_table(self.spark, self.args.work, self.args.sample, self.args.seed, self.cfg)
        best = context.top2(self.stored("scored_train")).join(meta.where("fold <> 0").select("q_id"), "q_id", "left_anti")
        e = training.group_folds(self.feed("train", 1).select(F.col("id").alias("s1")), "s1").where("fold = 0").select("s1")
        return best, e, self.truth().join(e, "s1", "left_semi")

    def tune(self) -> None:
        best, e, truth = self.unseen_scores()
        grid = decode.tuned(best.join(e, best["s1_id"] == e["s1"], "left_semi"), e, truth, [0.5, 0.6, 0.7, 0.8, 0.9], [0.0, 0.1, 0.2, 0.4], [0.0, 0.9])
        first = grid.where("half = 0").orderBy(F.desc("f05"), "threshold", "gap", "guard").first()
        same = (F.col("threshold") == first["threshold"]) & (F.col("gap") == first["gap"]) & (F.col("guard") == first["guard"]) & (F.col("half") == 1)
        self.note("decode", {**first.asDict(), "reported": grid.where(same).first()["f05"]})

    def calibrate(self) -> None:
        """The context model and the calibrators, from unseen scores."""
        best, _, _ = self.unseen_scores()
        owner = self.truth().select(F.col("other").alias("q_id"), F.col("s1").alias("owner"))
        same = lambda c: F.coalesce((F.col(c) == F.col("owner")).cast("int"), F.lit(0))
        models = training.fit_calibrators(best.join(owner, "q_id", "left").withColumns({"label": same("s1_id"), "label2": same("s1_id2")}), self.settings(training.CALIBRATOR))
        ctx = training.fit_context_model(context.context_features(best), self.truth(), self.settings(training.CONTEXT_TREES))
        for name, m in (("calibrator_1", models[0]), ("calibrator_2", models[1]), ("context_model", ctx)):
            training.save_model(m, f"{self.args.work}/{name}")

    def stage2_build(self) -> None:
        """Rows of the second stage for a split."""
        q = self.feed(self.args.split, 2, 3)
        self.save(linkage.second_stage(self.stored(f"scored_{self.args.split}"), self.feed(self.args.split, 1), aliases.prepared(q, self.alias_table(), self.args.alias_mode)), f"s2_{self.args.split}")

    def dropped(self) -> tuple[str, ...]:
        return tuple(x for x in self.args.drop.split(",") if x)

    def second_rows(self, split: str) -> DataFrame:
        """Rows of the second stage, with the reader's scores if asked for."""
        rows = self.stored(f"s2_{split}")
        return rows.join(self.stored(f"read_{split}"), ["q_id", "s1_id"], "left") if self.args.reader else rows

    def learning_rows(self) -> DataFrame:
        """Labelled rows of the training split. What a reader has learnt from is left out, so that none of its scores was fitted on its own label."""
        rows = rerank.labelled(self.second_rows("train"), self.truth())
        return rows.where("not reads") if self.args.reader else rows

    def reader_train(self) -> None:
        """A reader of hard pairs, from its third of half 0."""
        rows = rerank.labelled(self.stored("s2_train"), self.truth()).where("reads").where(F.col("p") <= self.args.hard)
        training.fit_reader(feats.pair_texts(rows).select("text1", "text2", "label")).write().overwrite().save(f"{self.args.work}/reader")

    def reader_score(self) -> None:
        rows = feats.pair_texts(self.stored(f"s2_{self.args.split}")).select("q_id", "s1_id", "p", "text1", "text2")
        read = training.score_pairs(rows, PipelineModel.load(f"{self.args.work}/reader"), self.args.hard)
        self.save(training.summed_logits(read, "p", "ce").select("q_id", "s1_id", "ce", F.col("combined").alias("ce_sum")), f"read_{self.args.split}")

    def stage2_train(self) -> None:
        """Fits on half of the entities and reports macro F0.5 on the others."""
        e = rerank.evaluate(self.learning_rows(), self.feed("train", 1), self.truth(), self.settings(training.SECOND), self.dropped())
        self.note("s2_eval", {"tau": e.best[0], "f05": e.best[1], "rounds": len(e.model.trees), "scores": e.scores})

    def gate(self) -> bool:
        """Whether the last evaluation beats the best one so far; then it is the best one."""
        e = self.noted("s2_eval")
        won = beats(self.spark, f"{self.args.work}/best", e["f05"], {"tau": e["tau"], "label": self.args.label})
        print("better" if won else "not better")
        return won

    def stage2_final(self) -> None:
        model, table = rerank.final(self.learning_rows(), max(1, self.noted("s2_eval")["rounds"]), self.settings(training.SECOND), self.dropped())
        training.save_model(model, f"{self.args.work}/s2_model")
        self.save(table, "s2_channel")

    def stage2_apply(self) -> None:
        self.save(rerank.scored(self.second_rows(self.args.split), training.load_model(f"{self.args.work}/s2_model"), self.stored("s2_channel")).select("q_id", "s1_id", "country", "r"), f"s2_scored_{self.args.split}")

    def accepted(self) -> DataFrame:
        """(q_id, s1_id) by the decoder asked for; countries that training has not seen are held to more."""
        split, args = self.args.split, self.args
        if args.decoder == "stage2":
            tau = args.tau or self.noted("s2_eval")["tau"]
            return decode.decide(self.stored(f"s2_scored_{split}"), tau, args.unseen_tau or None, self.feed("train", 1).select("country"))
        best = context.top2(self.stored(f"scored_{split}"))
        if args.decoder == "threshold":
            chosen = self.noted("decode")
            best = decode.accept(best, chosen["threshold"], chosen["gap"])
            return decode.entity_guard(best, chosen["guard"]) if chosen["guard"] else best
        seen, own = self.feed("train", 1).select("country"), self.feed(split, 1).select(F.col("id").alias("s1_id"), "country")
        if args.decoder == "context":
            r = training.apply_context_model(training.load_model(f"{args.work}/context_model"), context.context_features(best))
            return decode.discounted(r.join(own, "s1_id"), seen, args.unseen_discount).where(F.col("r") >= (args.tau or 0.7))
        models = [training.load_model(f"{args.work}/calibrator_{k}") for k in (1, 2)]
        r, mass = training.apply_calibrators((models[0], models[1]), best)
        r = decode.discounted(r.join(own, "s1_id"), seen, args.unseen_discount)
        return decode.expected_decode(r, decode.discounted(mass.join(own, "s1_id"), seen, args.unseen_discount, "mass").select("s1_id", "mass"))

    def submit(self) -> None:
        split = self.args.split
        entities = R.placed(self.feed(split, 1).select("id"))
        candidates = self.stored(f"s2_{split}" if self.args.decoder == "stage2" else f"scored_{split}").select("q_id", "s1_id")
        linkage.submit(entities, self.accepted().select("q_id", "s1_id"), f"{self.args.work}/lists_{split}", candidates, f"{self.args.work}/candidates_{split}").show(20, truncate=False)

    def snapshot(self) -> None:
        print(snapshot(self.args.file, f"{self.args.work}/snapshots", self.args.label, self.args.params, self.args.estimate, self.args.notes))


STEPS = ("normalize", "fit_aliases", "train", "score", "tune", "calibrate", "stage2_build", "reader_train", "reader_score", "stage2_train", "gate", "stage2_final", "stage2_apply", "submit", "snapshot")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("step", choices=STEPS)
    for name, default in (("root", "data"), ("work", "work"), ("split", "train"), ("splits", "train,test"), ("blocking", "v1"), ("alias-mode", "native"), ("file", ""), ("label", "run"), ("params", ""), ("estimate", "n/a"), ("notes", ""), ("drop", ""), ("decoder", "threshold")):
        p.add_argument(f"--{name}", default=default)
    for name, default in (("top-k", 30), ("sample", 300_000), ("seed", 7), ("rounds", 0), ("leaves", 0), ("least-rows", 0), ("alias-sample", 1_500_000), ("chunks", 4)):
        p.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("rate", 0.0), ("tau", 0.0), ("unseen-tau", 0.0), ("unseen-discount", 1.0), ("hard", 0.98)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--reader", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    getattr(Run(spark or SparkSession.builder.getOrCreate(), args), args.step)()


if __name__ == "__main__":
    main()
