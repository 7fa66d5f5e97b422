"""Quality rules as weak supervision.

Each rule reads a few counts of a text and votes 1 (good), 0 (bad) or null (abstains). A kind of junk has several
rules that look at it in different ways, by characters, by runs of them and by words. A document is good or junk of one kind;
expectation maximisation estimates how common each class is and how often every rule votes bad on it, that is, its
accuracy. A document is kept if its posterior probability of being good reaches ``KEEP_AT`` and the two base rules
pass: a lone bad vote of a rule that errs is outvoted, agreeing ones are not. All work on rows is native; the driver
sees only the table of distinct vote patterns, which has at most 3 ** len(RULES) rows at any input size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, stored, table

MIN_WORDS = 50
KEEP_AT = 0.5
#: name: (kind of junk, a ratio over the columns of features(), good up to, bad from); between the two a rule abstains.
RULES = {
    "symbols": ("symbols", "n_symbols / n_words", 0.02, 0.1),
    "symbol_runs": ("symbols", "n_symbol_runs / n_words", 0.02, 0.1),
    "capitals": ("capitals", "n_capitals / word_chars", 0.1, 0.25),
    "capital_runs": ("capitals", "n_capital_runs / n_words", 0.05, 0.2),
    "exclaims": ("capitals", "n_exclaims / n_words", 0.02, 0.1),
    "dup_lines": ("repeats", "n_dup_lines / n_lines", 0.1, 0.3),
    "repeats": ("repeats", "n_repeat_words / n_words", 0.1, 0.25),
    "stutters": ("repeats", "n_stutters / n_words", 0.02, 0.1),
    "same_words": ("repeats", "1 - n_distinct / n_words", 0.6, 0.8),
    "digits": ("shape", "n_digits / word_chars", 0.05, 0.15),
    "digit_runs": ("shape", "n_digit_runs / n_words", 0.1, 0.3),
    "long_words": ("shape", "word_chars / n_words", 9.0, 14.0),
    "long_lines": ("shape", "n_words / n_lines / 100", 4.0, 20.0),
}
CLASSES = ["good", *dict.fromkeys(r[0] for r in RULES.values())]
#: How often a rule is thought to vote bad before any data: on good documents, on junk of its kind, on other junk ...
THOUGHT = (0.02, 0.6, 0.1)
#: ... with the weight of this share of all documents, for each class.
WEIGHT = 0.02

def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, q): ``row`` holds the columns ``keep`` of ``docs`` (all but the text), ``q`` counts of words, characters, lines and repeats.

    A null text has no words. Everything stays in the row: repeated 3-word windows are found by sorting
    their (hash, position) pairs, and only in texts whose windows are not all different.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("row"), t.alias("_t"))
    own = own.withColumn("_w", F.array_remove(F.split("_t", f"[{SPACE}]+"), ""))
    own = own.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> rlike(x, '[^{SPACE}]'))".replace("\\", "\\\\")))
    own = own.withColumn("_h", F.expr("case when size(_w) < 4 then cast(array() as array<bigint>) else transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end"))
    own = own.withColumn(
        "_s",
        F.expr("case when size(array_distinct(_h)) = size(_h) then cast(null as array<struct<h: bigint, i: int>>) else sort_array(transform(_h, (x, i) -> struct(x as h, i as i))) end"),
    )
    own = own.withColumn("_e", F.expr("case when _s is null then 0 else size(filter(_h, (x, i) -> x <=> get(_h, i + 1))) end"))
    own = own.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h or x.h <=> get(_s, k + 1).h), x -> x.i))"))
    own = own.withColumn("_r", F.expr("coalesce(aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0, (a, x) -> a + x), 0)"))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    q = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_r").cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"!").alias("n_exclaims"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[#*$%&|<>]++").alias("n_symbol_runs"),
        count(r"\p{Lu}{2,}+").alias("n_capital_runs"),
        count(r"[0-9]++").alias("n_digit_runs"),
        F.col("_e").cast("long").alias("n_stutters"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )
    # a generator of one row: filters on q stay above it, else they would repeat all of this in their place
    return own.select("row", F.explode(F.array(q)).alias("q"))


def vote(rule: str) -> Column:
    """1, 0 or null; a text without words gets null from every rule."""
    _, ratio, good, bad = RULES[rule]
    r = F.expr(ratio.replace("n_", "q.n_").replace("word_chars", "q.word_chars"))
    return F.when(F.expr("q.n_words") > 0, F.when(r <= good, 1).when(r >= bad, 0)).cast("int")


def base_failed() -> Column:
    return F.expr(f"q.n_words < {MIN_WORDS} or 100 * q.n_repeat_words > 50 * q.n_words")


def estimate(patterns: list[tuple[tuple, int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, how often each rule votes bad on each class when it votes) from vote patterns and their counts.

    Starts from "junk of the kind of which most rules, and two at least, vote bad, else good", and is free to
    leave that. The shares are smoothed by one document, the rules by THOUGHT with WEIGHT.
    """
    kinds = np.array([CLASSES.index(r[0]) for r in RULES.values()])
    own = kinds[None, :] == np.arange(len(CLASSES))[:, None]
    thought = np.where(own, THOUGHT[1], THOUGHT[2])
    thought[0] = THOUGHT[0]
    bad, good = (np.array([[x == v for x in p] for p, _ in patterns], float).reshape(-1, len(RULES)) for v in (0, 1))
    count = np.array([n for _, n in patterns], float)
    votes = bad @ own.T
    first = np.where(votes.max(1, initial=0) >= 2, votes.argmax(1), 0)
    q = np.where(first[:, None] == np.arange(len(CLASSES)), 0.95, 0.05 / (len(CLASSES) - 1))
    for _ in range(rounds):
        w = (q * count[:, None]).T
        share = (w.sum(1) + 1) / (count.sum() + len(CLASSES))
        weight = WEIGHT * count.sum() + 1
        theta = (w @ bad + thought * weight) / (w @ (bad + good) + weight)
        z = np.log(share) + bad @ np.log(theta).T + good @ np.log(1 - theta).T
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
    return share, theta


def learn(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``estimate`` over the votes on all rows of ``features``; the driver gets one row for each pattern of votes."""
    votes = [vote(r).alias(f"v{j}") for j, r in enumerate(RULES)]
    seen = counted.where(F.expr("q.n_words > 0")).select(*votes).groupBy(*[f"v{j}" for j in range(len(RULES))]).count().collect()
    return estimate([(tuple(r)[:-1], r["count"]) for r in sorted(seen, key=str)])


def judged(counted: DataFrame, learnt: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``features`` with base_failed, p_good and kept. Empty and null texts fail the base rules; repeated rows are judged alike."""
    share, theta = learnt
    # log-odds of each kind of junk against good
    odds = [F.lit(float(x)) for x in np.log(share[1:] / share[0])]
    for j, r in enumerate(RULES):
        v = vote(r)
        for k in range(1, len(CLASSES)):
            no, yes = (float(np.log(f(theta[k, j]) / f(theta[0, j]))) for f in (lambda x: x, lambda x: 1 - x))
            odds[k - 1] = odds[k - 1] + F.when(v == 0, F.lit(no)).when(v == 1, F.lit(yes)).otherwise(0.0)
    out = counted.withColumns({"base_failed": base_failed(), "p_good": 1 / (1 + sum((F.exp(F.least(z, F.lit(60.0))) for z in odds[1:]), F.exp(F.least(odds[0], F.lit(60.0)))))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that the rules keep. An empty table gives an empty one.

    Two passes over the texts, one to learn and one to filter, and nothing of them is shuffled or stored.
    """
    learnt = learn(features(docs, text, []))
    return judged(features(docs, text, docs.columns), learnt).where("kept").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(features(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return judged(counted, learn(counted)).select(
        "row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )


QUERIES = {"op2_quality_rules": op2_quality_rules}
