"""What must not grow with the input: repeated work of a row, one task's groups, bytes of a shuffle."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.functions import text as X
from tessera.operators import blocking, channel, context
from tessera.operators import keys as K
from tessera.plans import linkage, rerank
from tessera.plans import queries as Q
from tessera.sources.stored import stored

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_names_words_are_made_once_a_row(spark):
    """Before, every subset made all words of the name again, and letters were made for the other family too."""
    df = spark.createDataFrame([("acme t00ls north",)], "n string")
    stop = F.array(F.lit("brand"))
    for families in (("nb",), ("ag",)):
        got = df.select(K.bag_subset_keys(F.col("n"), stop, 2, families).alias("k"))
        assert plan(got).count("RLIKE") <= 4
        assert sorted(got.first()[0]) == sorted(k for k in K.name_keys("acme t00ls north", {"brand"}, 2) if k[:2] in families)


def test_keys_of_addresses_make_none_of_names(spark):
    """Before, the whole index was built, and keys of names were made in Python, to be dropped."""
    got = plan(Q.v2_cross_keys(spark, SMALL))
    assert "name_keys" not in got and "Python" not in got


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_events_are_summed_in_tasks_of_counted_rows(spark, monkeypatch):
    """Before, all the rows of a frequent event met in one task. A pair with several rows, and rows without events, stay rows."""
    ev = [("nop", "a"), ("nop", "b"), ("nins", "c")]
    data = [(f"q{k}", f"s{k % 7}", k % 2, k % 3, [{"g": g, "event": e} for g, e in ev[: k % 4]]) for k in range(40)]
    df = spark.createDataFrame([*data, data[3]], "q_id string, s1_id string, label int, fold int, events array<struct<g string, event string>>")
    table = spark.createDataFrame([("nop", "a", 0.5), ("nins", "c", -1.0)], "g string, event string, llr double")
    want = rows(channel.channel_features(df, table))
    assert len(want) == 41 and want.count(next(r for r in want if r[0] == "q3")) == 2
    for settings in ({"ROWS_A_TASK": 5}, {"ROWS_A_TASK": 5, "BROADCAST_BYTES": 0, "OFTEN": 1}):
        for k, v in settings.items():
            monkeypatch.setattr(channel, k, v)
        got = channel.channel_features(df, table)
        assert rows(got) == want and "RepartitionByExpression [q_id#" in plan(got) and "], 9" in plan(got)


def test_evidence_is_summed_in_tasks_of_counted_queries(spark, monkeypatch):
    """Before, a task summed all pairs of however many queries AQE dealt to it in one map."""
    ref, q = Q._sides(spark, SMALL)
    index = blocking.build_index(ref)
    want = blocking.query_candidates(index, q, 3)
    monkeypatch.setattr(blocking, "QUERIES_A_TASK", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = blocking.query_candidates(index, q, 3)
        assert rows(got) == rows(want) and "], 8" in plan(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_second_stage_makes_siblings_and_ranks_once(spark, monkeypatch):
    """Before, the table of texts held the plans of sibling candidates and of ranks once for each step that reads them."""
    written = []

    def recorded(df):
        written.append(plan(df))
        return stored(df)

    monkeypatch.setattr(linkage, "stored", recorded)
    monkeypatch.setattr(context, "stored", recorded)
    pairs = stored(Q._party_scores(spark, SMALL))
    linkage.second_stage(pairs, *Q._sides(spark, SMALL))
    assert len(written) >= 6 and max(p.count("row_number()") for p in written) < 10  # before: 95 mentions in one plan


def test_documents_words_are_made_in_one_pass(spark):
    """Before, each word of a text was matched and joined as an object of its own. Every character reads as by the expressions; so do zeros."""
    df = spark.range(0x30000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    texts = df.select(F.concat(F.lit("Ab"), "c", F.lit("dE 007 "), "c", "c").alias("t"))
    odd = ["", " & ", "0", "00 000", "007 0x0 00&00 090", "a 00", "ΟΔΟΣ ΟΔΟΣ.", "İI ½&ﬁ\u2028x", "क़ख ㎏", "a\tb\nc\u00a0d", None]
    texts = texts.unionByName(spark.createDataFrame([(x,) for x in odd], "t string"))
    # beyond the 16-bit characters the definition is Python's, character by character
    words = X.tokens(F.when(F.col("t").rlike(r"[\x{10000}-\x{10FFFF}]"), X.fold_exact("t")).otherwise(X.fold(F.col("t"))))
    for first in (1, 2, 6):
        want = F.struct(F.array_join(F.slice(words, 1, first), " ").alias("head"), F.array_join(F.transform(F.slice(words, F.lit(first + 1), F.size(words)), X.without_zeros), " ").alias("rest"))
        both = texts.repartition(8).select("t", want.alias("w"), X.head_and_rest(F.col("t"), first).alias("g"))
        assert both.where(~F.col("g.head").eqNullSafe(F.col("w.head")) | ~F.col("g.rest").eqNullSafe(F.col("w.rest"))).take(3) == []
    assert plan(Q.document_records(spark, SMALL)).count("RLIKE") == 0


def test_channel_columns_read_stored_labels(spark):
    """Before, each step of the cross-fitted columns shuffled and labelled all rows again."""
    data = [(f"S2-{k}", f"S1-{k % 7}", 0.5, k % 2, [("nop", "a")]) for k in range(40)]
    df = spark.createDataFrame(data, "q_id string, s1_id string, p double, q_rank int, events array<struct<g string, event string>>")
    truth = spark.createDataFrame([(f"S2-{k}", f"S1-{k % 7}") for k in range(0, 40, 3)], "other string, s1 string")
    got = rerank.with_channel(rerank.labelled(df, truth))
    assert got.count() == 40 and "true_s1#" in plan(got) and "other#" not in plan(got) and "Window" not in plan(got)


def test_windows_of_a_batch_slide_together():
    """Before, each pair counted the characters of its windows alone. Bounds and their order are the same."""
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        letters = rng.choice(["ab", "abcdefgh 0", "कमलab", "abcé😀"])
        pairs.append(sorted(("".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(2)), key=len))
    for (s, t), got in zip(pairs, similarity._bounded_many([p[0] for p in pairs], [p[1] for p in pairs]), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(got, similarity._bounded(s, t), strict=True))
