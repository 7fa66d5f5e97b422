import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aliases, blocking, channel, context, decode, rawcheck, training
from tessera.operators import features as feats
from tessera.operators import keys as K
from tessera.operators.boosting import Settings
from tessera.sources import gate
from tessera.sources import records as R
from tessera.sources.stored import cached, stored

REC = "id string, country string, name_n string, addr_n string, name_sq string, is_domain boolean"


def recs(spark, *rows):
    return spark.createDataFrame([(i, c, n, a, n.replace(" ", ""), False) for i, c, n, a in rows], REC)


def test_subset_keys_survive_an_added_word(spark):
    df = spark.createDataFrame([("acme tools north",), ("acme tools",), ("zenith gmbh",)], "n string")
    keys = [set(r[0]) for r in df.select(K.bag_subset_keys(F.col("n"), F.array(F.lit("gmbh")), 2)).collect()]
    assert "nb:acme tools" in keys[0] & keys[1] and not keys[1] & keys[2] and "nb:gmbh" not in keys[2]


def test_subsets_match_brute_force(spark):
    words = ["a", "b", "c", "d"]
    got = spark.createDataFrame([(" ".join(words),)], "n string").select(K.subsets(K.name_bag(F.col("n")), 2)).first()[0]
    want = [(d, tuple(w for w in words if w not in cut)) for d in (0, 1, 2) for cut in itertools.combinations(words, d)]
    assert sorted((x["d"], tuple(x["words"])) for x in got) == sorted(want)


def test_house_numbers(spark):
    got = spark.createDataFrame([("0123 main 7 x 000 9 44",)], "a string").select(K.house_numbers(F.col("a"))).first()[0]
    assert got == ["123", "7", "9", "23", "13", "12"]


def test_capped_keys_leave_the_index(spark):
    ref = recs(spark, *[(f"S1-{i}", "x", f"common w{i}", f"{i} road") for i in range(50)])
    keys = {r["key"] for r in blocking.build_index(ref).keys.collect()}
    assert "n:w3" in keys and "n:common" not in keys and "a:road" not in keys


def test_candidates_of_both_retrievals(spark):
    ref = recs(spark, ("S1-1", "x", "lovely garden centre", "12 park lane"), ("S1-2", "x", "iron works", "99 mill road"), ("S1-3", "y", "lovely garden centre", "12 park lane"))
    q = recs(spark, ("S2-1", "x", "garden lovely centre", "13 park lane"), ("S2-2", "x", "nothing alike", ""))
    first = blocking.generate_candidates(ref, q, 5)
    assert {(r["q_id"], r["s1_id"]) for r in first.collect()} == {("S2-1", "S1-1")}
    both = blocking.union_candidates(first, blocking.corruption_hits(blocking.build_corruption_index(ref, K.CorruptionConfig(stop_share=2.0)), q)).collect()
    assert len(both) == 1 and both[0]["in_v1"] == both[0]["in_v2"] == 1 and both[0]["v2_k_nb"] > 0


def test_one_sum_for_both_retrievals_is_their_union(spark):
    from tessera.plans import queries as Q

    ref, q = Q._sides(spark, "/root/testdata/sf0.001")
    first, second = blocking.build_index(ref), blocking.build_corruption_index(ref)
    want = blocking.union_candidates(blocking.query_candidates(first, q, 3), blocking.corruption_hits(second, q), 2)
    got = blocking.query_union(first, second, q, 3, 2)
    rows = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.select(sorted(want.columns)).collect())
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and {r["in_v1"] + r["in_v2"] for r in want.collect()} == {1, 2}


def test_aliases(spark):
    p = spark.createDataFrame([("red shop", "1 a", "rot shop", "1 a")] * 6, "n1 string, a1 string, n2 string, a2 string")
    t = aliases.fit_aliases(p)
    assert [(r["q_tok"], r["s_tok"], r["total"], r["purity"]) for r in t.collect()] == [("rot", "red", 6, 1.0)]
    q = recs(spark, ("S2-1", "x", "rot haus", "rot"))
    assert aliases.apply_aliases(q, t, "native").first()["name_n"] == "rot haus"
    assert aliases.apply_aliases(q, t, "all").first()["name_sq"] == "redhaus"


def test_blank_addresses_share_one_empty_token(spark):
    t = spark.createDataFrame([("a", "", "a", "")], "n1 string, a1 string, n2 string, a2 string")
    got = feats.token_features(t).first()
    assert got["a_shared_tok"] == got["a2_ntok"] == 1


def test_top2_and_context(spark):
    s = spark.createDataFrame([("S2-1", "A", 0.9), ("S2-1", "B", 0.4), ("S3-2", "A", 0.95), ("S3-3", "B", 0.5)], "q_id string, s1_id string, p double")
    best = {r["q_id"]: r for r in context.top2(s).collect()}
    assert best["S2-1"]["s1_id2"] == "B" and best["S3-2"]["p2"] == 0 and best["S3-2"]["s1_id2"] is None
    ctx = {(r["q_id"], r["s1_id"]): r for r in context.entity_context(context.query_context(s)).collect()}
    assert ctx["S2-1", "A"]["e_strong"] == 1 and ctx["S2-1", "A"]["e_max"] == 0.95 and ctx["S2-1", "B"]["e_n"] == 1 and ctx["S3-3", "B"]["e_n"] == 0
    leak = {r["q_id"]: r["leak"] for r in context.context_features(context.top2(s)).collect()}
    assert leak["S3-3"] == 0.4 and leak["S3-2"] == 0


def test_expected_decoding_matches_enumeration():
    rng = random.Random(2)
    for _ in range(6):
        n = rng.randint(1, 5)
        r, mu = sorted((rng.random() for _ in range(n)), reverse=True), rng.random()
        tail = [math.exp(-mu) * mu**j / math.factorial(j) for j in range(decode.SUPPORT)]
        tail[-1] += 1 - sum(tail)

        def score(k):
            total = 0.0
            for hit in itertools.product((0, 1), repeat=n):
                w = math.prod(p if h else 1 - p for p, h in zip(r, hit, strict=True))
                for j, t in enumerate(tail):
                    true, tp = sum(hit) + j, sum(hit[:k])
                    f = float(k == 0) if true == 0 else 0.0 if tp == 0 else 1.25 * tp / (0.25 * true + k)
                    total += w * t * f
            return round(total, 9)

        want = max(range(n + 1), key=lambda k: (score(k), -k))
        assert decode.best_count(np.array([r + [0.0] * (decode.MOST - n)]), np.array([mu]))[0] == want


def test_macro_f05(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")
    t = spark.createDataFrame([("a", "1"), ("a", "2")], "s1 string, other string")
    p = spark.createDataFrame([("a", "1"), ("c", "9")], "s1 string, other string")
    got = {r["s1"]: r["f"] for r in decode.entity_scores(e, t, p).collect()}
    assert got["b"] == 1 and got["c"] == 0 and got["a"] == pytest.approx(1.25 * 0.5 / 0.75)


def test_lists_are_written_without_quotes(spark, tmp_path):
    e = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "id string, pos int")
    a = spark.createDataFrame([("S3-9", "S1-2"), ("S2-1", "S1-2")], "q_id string, s1_id string")
    R.write_lists(decode.assemble(e, a), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text == b"source1_entity_id\tmatched_entity_ids\nS1-2\tS2-1,S3-9\nS1-1\t\n"
    assert decode.violations(decode.assemble(e, a), e).isEmpty()


def test_raw_records_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A" & B\t\tx\n')
    got = R.normalized(R.read_tsv(spark, str(tmp_path / "x.tsv"))).first()
    assert got["name_n"] == "a and b" and got["addr_n"] == ""


def plain_script(s: str, q: str) -> list[tuple[str, str, int]]:
    """(from, to, place in s) of the edits of one shortest script, '' for nothing."""
    d = [[i + j if not i * j else 0 for j in range(len(q) + 1)] for i in range(len(s) + 1)]
    for i, a in enumerate(s, 1):
        for j, b in enumerate(q, 1):
            d[i][j] = min(d[i - 1][j - 1] + (a != b), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = len(s), len(q), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (s[i - 1] != q[j - 1]):
            i, j = i - 1, j - 1
            if s[i] != q[j]:
                out.append((s[i], q[j], i))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((s[i], "", i))
        else:
            j -= 1
            out.append(("", q[j], i))
    return out[::-1]


def plain_field(s, q):
    a, b = ([*dict.fromkeys(t for t in x if t and t not in y)] for x, y in ((s.split(" "), q.split(" ")), (q.split(" "), s.split(" "))))
    if len(a) > channel.MOST_REST or len(b) > channel.MOST_REST:
        return ["#many"], [], []
    word = lambda t: f"#num{len(t)}" if t.isdigit() else t
    ops, ins = [], []
    for t in b:
        scored = [(1 - len(plain_script(x, t)) / max(len(x), len(t)), -k) for k, x in enumerate(a)]
        if scored and max(scored)[0] >= channel.SIMILAR:
            x = a.pop(-max(scored)[1])
            ops += channel.script_events(x, plain_script(x, t))
        else:
            ins.append(word(t))
    return ops, ins, [word(t) for t in a]


def test_batched_scripts_are_those_of_single_tables(monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé1२") for _ in range(n))
    pairs = [(word(rng.randint(0, 9)), word(rng.randint(0, 14))) for _ in range(700)] + [("", ""), ("a", ""), ("", "abc"), ("same", "same"), (word(300), word(280))]
    monkeypatch.setattr(channel, "TABLE_CELLS", 500)
    assert channel.edit_scripts(pairs) == [plain_script(*p) for p in pairs]
    assert channel.distances(pairs).tolist() == [len(plain_script(*p)) for p in pairs]
    text = lambda: " ".join(word(rng.randint(1, 6)) for _ in range(rng.randint(0, 9)))
    fields = [(text(), text()) for _ in range(300)]
    assert channel.field_events(fields) == [plain_field(*f) for f in fields]
    assert channel.field_events([]) == [] and channel.edit_scripts([]) == []


def test_edit_events():
    assert channel.edit_scripts([("abc", "abd")]) == [[("c", "d", 2)]]
    got = channel.field_events([("main street 12", "main stret 13"), ("a b c d e f g", "z")])
    assert got[0][0][0] == "e>" and got[1] == (["#many"], [], [])


def test_channel_tables_leave_their_fold_out(spark):
    rows = [(str(i), "x", i % 2, i % 5, [("nop", "e")] if i % 2 else [("nop", "f")]) for i in range(40)]
    ev = spark.createDataFrame(rows, "q_id string, s1_id string, label int, fold int, events array<struct<g: string, event: string>>")
    got = {(r["fold"], r["event"]): (r["pos"], r["neg"]) for r in channel.fold_tables(ev).collect()}
    assert got[None, "e"] == (20, 0) and got[0, "e"] == (16, 0) and got[3, "f"] == (0, 16)


def test_missing_features_reach_trees(spark):
    rows = spark.createDataFrame([(i % 2, i % 5, float(i % 2) if i % 3 else None) for i in range(60)], "label int, fold long, x double")
    spec = feats.FeatureSpec(("x",))
    out = training.predict(training.fit_matcher(rows, spec, Settings(rounds=2, rate=0.9, least_rows=5)), rows, keep=0.0)
    assert out.count() == 60 and {r["p"] > 0.5 for r in out.where("x = 1").collect()} == {True}
    assert feats.FeatureSpec(("e_a", "b")).drop("e_*").names == ("b",)


def test_registered_stage_2_has_the_siblings(spark):
    from tessera.plans.queries import QUERIES

    got = QUERIES["stage2_rows"](spark, "/root/testdata/sf0.001")
    assert {"sc_n", "sib_addr_shared", "n_events"} <= set(got.columns) and got.agg(F.count_if(F.col("sc_n") > 0)).first()[0] > 0


def _pair_rows(spark, name):
    from tessera.plans import queries as Q

    return {r["q_id"]: r for r in Q._pairs(spark, "/root/testdata/sf0.001").collect()}, Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


@pytest.mark.parametrize(("name", "cols"), [("indel_ratio", {"n_ratio": ("n1", "n2", "ratio"), "n_tsort": ("n1", "n2", "tsort")}), ("token_set_ratio", {"a_tset": ("a1", "a2", "tset"), "a_partial": ("a1", "a2", "ptset")}), ("partial_ratio", {"sq_partial": ("q1", "q2", "partial")})])
def test_kernel_queries_against_loops(spark, name, cols):
    from tests.test_text import NAIVE

    pairs, got = _pair_rows(spark, name)
    assert len(got) == len(pairs) > 100
    for r in got:
        for c, (x, y, kernel) in cols.items():
            assert r[c] == pytest.approx(NAIVE[kernel](pairs[r["q_id"]][x], pairs[r["q_id"]][y]), abs=2e-6)


def test_number_ratio_is_of_all_numbers_in_order(spark):
    t = spark.createDataFrame([("x", "12 main 7", "x", "12 lane 9"), ("x", "7 a 12", "x", "12 a 7")], "n1 string, a1 string, n2 string, a2 string")
    t = t.withColumns({"q1": F.col("n1"), "q2": F.col("n2")})
    got = feats.kernel_features(feats.rest_features(feats.leftover_features(t))).collect()
    assert got[0]["num_ratio"] == 75 and got[0]["m_rest_ratio"] == 0 and (got[0]["m_rest_len1"], got[0]["m_rest_len2"]) == (1, 1)
    assert got[1]["num_ratio"] == 50 and got[1]["m_rest_ratio"] == 100


def test_words_with_a_digit_are_no_plain_words(spark):
    df = spark.createDataFrame([(["ann"], ["12a", "main", "9"])], "n array<string>, a array<string>")
    assert df.select(K.cross_keys(F.col("n"), F.col("a"))).first()[0] == ["c:ann_main"]
    q = recs(spark, ("S2-1", "x", "a b", "12a main 34"), ("S2-2", "y", "a b", "12a main 34"))
    assert {r["key"] for r in context.sibling_keys(q).collect()} == {"b:12a 34 main", "h:12_main", "h:34_main"}


def test_sibling_divergences_keep_to_themselves(spark):
    ref = recs(spark, ("S1-1", "x", "acme tools", "4211 oak street"))
    texts = {"S3-1": ("acme tools", "4210 oak street"), "S3-2": ("acme tools inc", "4210 oak street"), "S2-3": ("acme tools inc", "4210 elm street"), "S3-4": ("acme tools", "4211 oak street")}
    q = recs(spark, *[(i, "x", n, a) for i, (n, a) in texts.items()])
    s = spark.createDataFrame([("S3-1", "S1-1", 0.95), ("S3-2", "S1-1", 0.5), ("S2-3", "S1-1", 0.93), ("S3-4", "S1-1", 0.99)], "q_id string, s1_id string, p double")
    got = {r["q_id"]: tuple(r)[2:] for r in context.sibling_features(feats.with_texts(context.query_context(s), ref, q), ref).collect()}
    # (address divergences, most shared, of the same feed, name divergences, most shared)
    assert got == {"S3-1": (1, 1, 0, 0, 0), "S3-2": (1, 1, 1, 1, 1), "S2-3": (2, 1, 0, 1, 0), "S3-4": (0, 0, 0, 0, 0)}


def test_index_uses_one_spelling_of_an_alias_class(spark):
    table = spark.createDataFrame([("n", "ltd", "limited", 20, 20, 1.0), ("a", "tx", "texas", 20, 20, 1.0), ("n", "ltee", "limited", 20, 20, 1.0)], "field string, q_tok string, s_tok string, cnt long, total long, purity double")
    assert {tuple(r) for r in aliases.alias_classes(table).collect()} == {("n", "limited", "ltd"), ("n", "ltee", "ltd"), ("a", "texas", "tx")}
    ref = recs(spark, ("S1-1", "x", "acme limited", "1 oak texas"), ("S1-2", "x", "texas limited", "2 elm"))
    q = recs(spark, ("S2-1", "x", "ltee acme", "9 ash tx"))
    cfg = K.CorruptionConfig(stop_share=2.0)
    plain, same = (blocking.corruption_hits(blocking.build_corruption_index(ref, cfg, t), q, cfg).where("s1_id = 'S1-1'").first() for t in (None, table))
    assert plain["v2_k_nb"] == 1 and same["v2_k_nb"] == 2 + 1 and same["v2_nkeys"] > plain["v2_nkeys"]


def test_expected_decode_query_against_enumeration(spark):
    from tessera.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    by = {}
    for r in Q.scored(spark, sf).where("p >= 0.3").collect():
        by.setdefault(r["s1_id"], []).append((-r["p"], r["q_id"]))
    want = set()
    for e, rows in by.items():
        rows = sorted(rows)[: decode.MOST]
        r = np.array([[-x for x, _ in rows] + [0.0] * (decode.MOST - len(rows))])
        tail = [math.exp(-0.02) * 0.02**j / math.factorial(j) for j in range(decode.SUPPORT)]
        tail[-1] += 1 - sum(tail)
        p = r[0][: len(rows)]
        hits = np.array(list(itertools.product((0, 1), repeat=len(p))))
        w = np.prod(np.where(hits, p, 1 - p), axis=1)
        score = []
        for k in range(len(p) + 1):
            tp = hits[:, :k].sum(1)
            total = 0.0
            for j, t in enumerate(tail):
                true = hits.sum(1) + j
                f = (true == 0).astype(float) if k == 0 else np.where(tp == 0, 0.0, 1.25 * tp / (0.25 * true + k))
                total += t * (w * f).sum()
            score.append(round(total, 12))
        want |= {(e, q) for _, q in rows[: int(np.argmax(score))]}
    assert {(r["s1_id"], r["q_id"]) for r in Q.QUERIES["expected_decode"](spark, sf).collect()} == want


def test_channel_events_query_replays_its_scripts(spark):
    pairs, got = _pair_rows(spark, "channel_events")
    assert len(got) == len(pairs)
    for r in got:
        p = pairs[r["q_id"]]
        ev = [e.split("=", 1) for e in r["events"].split(",")] if r["events"] else []
        for g, x, y in (("n", p["n1"], p["n2"]), ("a", p["a1"], p["a2"])):
            s, t = x.split(" "), y.split(" ")
            words = lambda u: [f"#num{len(w)}" if w.isdigit() else w for w in u]
            left, right = ([w for w in dict.fromkeys(u) if w and w not in v] for u, v in ((s, t), (t, s)))
            ins, dele = ([e for k, e in ev if k == f"{g}{o}"] for o in ("ins", "del"))
            assert set(ins) <= set(words(right)) and set(dele) <= set(words(left)) and len(left) - len(dele) == len(right) - len(ins)


def test_context_model_and_calibrators_learn(spark):
    rng = random.Random(7)
    rows = [(f"S{2 + i % 2}-{i}", f"S1-{i % 40}", p := rng.random(), f"S1-{(i + 1) % 40}", rng.random() * p) for i in range(600)]
    best = spark.createDataFrame(rows, "q_id string, s1_id string, p1 double, s1_id2 string, p2 double")
    truth = spark.createDataFrame([(r[1] if r[2] > 0.5 else "S1-x", r[0]) for r in rows], "s1 string, other string")
    ctx = context.context_features(best)
    r = training.apply_context_model(training.fit_context_model(ctx, truth, Settings(rounds=6, rate=0.5, leaves=15)), ctx)
    assert r.count() == 600 and r.where("p1 > 0.6").agg(F.avg("r")).first()[0] > 0.8 > 0.3 > r.where("p1 < 0.4").agg(F.avg("r")).first()[0]
    lab = best.withColumns({"label": (F.col("p1") > 0.5).cast("int"), "label2": (F.col("p2") > 0.5).cast("int")})
    got, mass = training.apply_calibrators(training.fit_calibrators(lab, Settings(rounds=6, rate=0.5, leaves=15)), best)
    assert got.join(best, "q_id").where("abs(r - if(p1 > 0.5, 1, 0)) > 0.2").count() < 60 and mass.count() == 40


def test_reader_tells_hard_pairs_apart(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdegiklmnorst") for _ in range(7))
    rows = []
    for i in range(400):
        a, b = word(), word()
        rows.append((f"{a} {b}", f"{a} {b} ltd" if i % 2 else f"{a} {word()}", i % 2, 0.5))
    df = spark.createDataFrame(rows, "text1 string, text2 string, label int, p double")
    got = training.score_pairs(df.unionByName(df.limit(1).withColumn("p", F.lit(0.99))), training.fit_reader(df, 1 << 12))
    assert training.pair_quality(got.where("p < 0.9"), "ce")["auc"] > 0.95 and got.where("p > 0.9").first()["ce"] == 0.99


def test_steps_run_from_files_to_files(spark, tmp_path):
    from tessera import __main__ as cli
    from tessera.plans import queries as Q

    root, work = tmp_path / "data", str(tmp_path / "work")
    (root / "train").mkdir(parents=True)
    p = [r for r in Q.parties(spark, "/root/testdata/sf0.001").orderBy("id").collect()]
    for k in (1, 2, 3):
        rows = [f"{r['id']}\t{r['name_n']}\t{r['addr_n'] or 'N/A'}\t{r['country']}" for r in p if r["role"] == k - 1]
        (root / "train" / f"train_source{k}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *rows]) + "\n")
    own = {}
    for r in p:
        if r["role"] and r["owner"]:
            own.setdefault(r["owner"], []).append(r["id"])
    (root / "train" / "train_ground_truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *(f"{r['id']}\t{','.join(own.get(r['id'], []))}" for r in p if r["role"] == 0)]) + "\n")
    run = lambda step, *more: cli.main([step, "--root", str(root), "--work", work, "--splits", "train", "--top-k", "4", "--rounds", "4", "--leaves", "6", "--least-rows", "5", "--rate", "0.6", *more], spark)
    for step in ("normalize", "fit_aliases", "train", "score", "tune", "calibrate", "stage2_build", "stage2_train", "gate", "stage2_final", "stage2_apply"):
        run(step)

    def f05(decoder, *more):
        run("submit", "--decoder", decoder, *more)
        out = next((tmp_path / "work" / "lists_train").glob("part-*"))
        lists = dict(line.split("\t") for line in out.read_text().splitlines()[1:])
        assert [*lists] == sorted(r["id"] for r in p if r["role"] == 0)
        fs = []
        for e, x in lists.items():
            got, want = {q for q in x.split(",") if q}, {*own.get(e, [])}
            tp = len(got & want)
            fs.append(float(not got) if not want else 0.0 if not tp else 1.25 * (tp / len(got)) * (tp / len(want)) / (0.25 * tp / len(got) + tp / len(want)))
        return sum(fs) / len(fs), out

    first, _ = f05("threshold")
    second, _ = f05("stage2")
    assert second > first > 0.6 and second > 0.85, (first, second)
    assert min(f05("expected")[0], f05("context", "--tau", "0.5")[0]) > 0.6
    # held-out entities: the second stage beats the first stage's threshold
    report = cli.Run(spark, cli.parser().parse_args(["tune", "--work", work])).noted("s2_eval")
    assert report["f05"] > next(f for t, f in report["scores"] if t is None)
    made = cli.Run(spark, cli.parser().parse_args(["gate", "--work", work]))
    assert not made.gate() and made.noted("s2_eval")["f05"] == gate.best(spark, f"{work}/best")[1]["score"]
    # with a reader in the chain, whose own rows the second stage leaves out
    for step in ("reader_train", "reader_score"):
        run(step)
    for step in ("stage2_train", "stage2_final", "stage2_apply"):
        run(step, "--reader")
    read = made.stored("read_train")
    assert read.count() == made.stored("s2_train").count() and set(read.columns) == {"q_id", "s1_id", "ce", "ce_sum"}
    assert {"ce", "ce_sum"} <= {*training.load_model(f"{work}/s2_model").names}
    third, out = f05("stage2")
    assert third > 0.85, third
    for n in (1, 2):
        run("snapshot", "--file", str(out), "--label", "First run!")
    folders = sorted(x.name for x in (tmp_path / "work" / "snapshots").iterdir() if x.is_dir())
    assert folders == ["01_first-run", "02_first-run"] and (tmp_path / "work" / "snapshots" / "LOG.md").read_text().count("| First run! |") == 2


def test_pair_features_query_against_loops(spark):
    from tessera.plans import queries as Q
    from tests.test_text import NAIVE

    sf = "/root/testdata/sf0.001"
    texts = {r["id"]: r for r in Q.parties(spark, sf).collect()}
    rows = Q.QUERIES["pair_features"](spark, sf).collect()
    assert len(rows) == len({(r["q_id"], r["s1_id"]) for r in rows}) > 500
    digits = lambda x: "".join(c if c.isdigit() else " " for c in x).split()
    left = lambda a, b: " ".join(sorted({w for w in a if w not in b}))
    for r in rows[::7]:
        a, b = texts[r["s1_id"]], texts[r["q_id"]]
        n, m, q = (a["name_n"], b["name_n"]), (a["addr_n"], b["addr_n"]), (a["name_sq"], b["name_sq"])
        w, v, d = (tuple(x.split(" ") for x in y) for y in (n, m, tuple(" ".join(digits(x)) for x in m)))
        want = {
            "n_ratio": NAIVE["ratio"](*n), "n_tsort": NAIVE["tsort"](*n), "n_tset": NAIVE["tset"](*n), "n_jw": NAIVE["jw"](*n), "a_ratio": NAIVE["ratio"](*m), "a_tset": NAIVE["tset"](*m),
            "a_partial": NAIVE["ptset"](*m), "a_jw": NAIVE["jw"](*m), "sq_ratio": NAIVE["ratio"](*q), "sq_partial": NAIVE["partial"](*q), "num_ratio": NAIVE["ratio"](*(" ".join(digits(x)) for x in m)),
            "n_rest_ratio": NAIVE["ratio"](left(w[0], w[1]), left(w[1], w[0])), "a_rest_ratio": NAIVE["ratio"](left(v[0], v[1]), left(v[1], v[0])),
            "n_rest_len1": len(left(w[0], w[1])), "a_rest_len2": len(left(v[1], v[0])), "m_rest_len1": len(left(digits(m[0]), digits(m[1]))), "n_shared_tok": len(set(w[0]) & set(w[1])), "n1_len": len(n[0]), "n_exact": int(n[0] == n[1]),
            "num_inter": len(set(digits(m[0])) & set(digits(m[1]))), "q_addr_empty": int(m[1] == ""), "q_is_domain": int(b["is_domain"]), "n_len_ratio": len(n[0]) / max(len(n[1]), 1),
        }
        for c, x in want.items():
            assert r[c] == pytest.approx(x, rel=1e-5, abs=1e-5), (c, n, m)


def test_unseen_countries_are_held_to_more(spark):
    rows = spark.createDataFrame([("q1", "a", 0.8, "x"), ("q2", "b", 0.8, "y"), ("q3", "c", 0.96, "y"), ("q3", "d", 0.97, "x")], "q_id string, s1_id string, r double, country string")
    seen = spark.createDataFrame([("x",), ("x",)], "country string")
    got = lambda *a: {(r["q_id"], r["s1_id"]) for r in decode.decide(rows, *a).collect()}
    assert got(0.7) == {("q1", "a"), ("q2", "b"), ("q3", "d")}
    assert got(0.7, 0.9, seen) == {("q1", "a"), ("q3", "d")}
    assert {r["s1_id"]: round(r["r"], 3) for r in decode.discounted(rows, seen, 0.5).collect()} == {"a": 0.8, "b": 0.4, "c": 0.48, "d": 0.97}
    assert decode.discounted(rows, seen.limit(0), 0.5).agg(F.max("r")).first()[0] == 0.485


def test_one_of_two_equal_runs_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    at = str(tmp_path / "best")
    assert gate.best(spark, at) == (0, {})
    assert gate.beats(spark, at, 0.5, {"tau": 0.7}) and not gate.beats(spark, at, 0.5) and not gate.beats(spark, at, 0.4)
    with ThreadPoolExecutor(6) as pool:
        won = [*pool.map(lambda s: (s, gate.beats(spark, at, s)), [0.6] * 3 + [0.7] * 3)]
    assert sum(w for s, w in won if s == 0.7) == 1 and sum(w for s, w in won if s == 0.6) <= 1
    assert gate.best(spark, at)[1]["score"] == 0.7


def test_a_cache_that_a_crash_left_is_built_again(spark, tmp_path):
    at, built = str(tmp_path / "c"), []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cached(spark, at, build).count() == 3
    (tmp_path / "c" / "_SUCCESS").unlink()
    assert cached(spark, at, build).count() == 3 and len(built) == 2


def test_cross_fitted_columns_against_loops(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        events = [(rng.choice(channel.GROUPS), rng.choice("abc")) for _ in range(rng.randint(0, 5))]
        rows.append((f"q{i}", f"s{i % 9}", int(rng.random() < 0.4), rng.randrange(4), rng.randrange(2), events))
    df = spark.createDataFrame(rows, "q_id string, s1_id string, label int, sub int, half int, events array<struct<g:string,event:string>>").repartition(3)
    got = {r["q_id"]: r for r in channel.cross_fitted(df, F.col("half") == 0).collect()}

    def llr(ev, leave):
        use = [r for r in rows if r[4] == 0 and r[3] != leave]
        kp = sum(r[2] for r in use)
        pos, neg = (sum(ev in r[5] for r in use if r[2] == y) for y in (1, 0))
        return math.log((pos + 1) / (kp + 1)) - math.log((neg + 1) / (len(use) - kp + 1)) if pos + neg >= 5 else None

    for q, _, _, sub, half, events in rows:
        for g in channel.GROUPS:
            own = [llr(e, sub if half == 0 else None) for e in events if e[0] == g]
            known = [x for x in own if x is not None]
            r = got[q]
            assert (r[f"{g}_n"], r[f"{g}_unknown"]) == (len(own), len(own) - len(known))
            assert r[f"{g}_sum"] == pytest.approx(sum(known)) and (r[f"{g}_min"] is None) == (not known)
            assert not known or r[f"{g}_min"] == pytest.approx(min(known))


def test_summed_logits(spark):
    df = spark.createDataFrame([(0.5, 0.9), (0.9, 0.9), (0.0, 1.0)], "p double, ce double")
    got = [r["combined"] for r in training.summed_logits(df, "p", "ce").collect()]
    assert got == pytest.approx([0.9, 81 / 82, 0.5])


def test_an_index_outlives_its_run_and_scoring_goes_on(spark, tmp_path, monkeypatch):
    from tessera.operators import boosting
    from tessera.plans import linkage
    from tessera.plans import queries as Q

    ref, q = Q._sides(spark, "/root/testdata/sf0.001")
    cfg = linkage.PlanConfig(blocking="v2", top_k=4)
    monkeypatch.setattr(blocking, "BUCKET_BYTES", 20_000)
    at = str(tmp_path / "index")
    kept = linkage.indexes(ref, cfg, keep=at)
    rows = lambda d: sorted(tuple(r) for r in d.select(sorted(d.columns)).collect())
    want = rows(linkage.candidates(ref, q, cfg))
    assert rows(linkage.candidates(ref, q, cfg, index=kept)) == want
    # a second run, in a session of its own, builds nothing
    for name in ("build_index", "build_corruption_index"):
        monkeypatch.setattr(blocking, name, None)
    other = spark.newSession()
    there = lambda d: other.read.schema(d.schema).parquet(*d.inputFiles()).where("role = 0" if d is ref else "role > 0")
    again = linkage.indexes(there(ref), cfg, keep=at)
    assert rows(linkage.candidates(there(ref), there(q), cfg, index=again)) == want
    # beyond the bound of a broadcast, query keys are dealt to the lists and the lists stay in their buckets
    monkeypatch.setattr(blocking, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = K.all_keys(q.withColumn("id", F.monotonically_increasing_id()), kept.first.vocab, 5, K.KeyConfig())
        plan = blocking._probe(kept.first, stored(keys))._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount" in plan and plan.count("Exchange hashpartitioning(country") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    # another reference is another index
    assert blocking.kept_index(spark, f"{at}/first", "other") is None
    # a killed run goes on: whole parts stay, and a part without its mark is made again
    model = boosting.Boosted(("score",), [np.array([5.0])], 0.0, [])
    run = lambda: linkage.score_in_chunks(ref, q, model, str(tmp_path / "chunks"), 3, None, linkage.PlanConfig(top_k=4), str(tmp_path / "i"))
    pairs, alone = (rows(d) for d in run())
    assert {r[0] for r in alone}.isdisjoint({r[1] for r in pairs}) and len({r[1] for r in pairs}) + len(alone) == q.count()
    part = next((tmp_path / "chunks").glob("*/pairs/chunk=1"))
    (part / "_SUCCESS").unlink()
    done, score = [], linkage.score
    monkeypatch.setattr(linkage, "score", lambda *a: done.append(1) or score(*a))
    assert [rows(d) for d in run()] == [pairs, alone] and len(done) == 1


def test_raw_files_are_checked_line_by_line(spark, tmp_path):
    ents = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "id string")

    def faults(text, cand=None, **more):
        (tmp_path / "m.tsv").write_text(text)
        if cand:
            (tmp_path / "c.tsv").write_text(cand)
            more["candidates"] = rawcheck.numbered_lines(spark, str(tmp_path / "c.tsv"))
        got = rawcheck.violations(rawcheck.numbered_lines(spark, str(tmp_path / "m.tsv")), ents, **more).collect()
        return sorted((r["rule"], r["line"] or 0, r["id"] or "") for r in got)

    head = "source1_entity_id\tmatched_entity_ids\n"
    assert faults(head + "S1-1\t\nS1-2\tS2-1,S3-1\nS1-3\t\n", known=known) == []
    assert faults("") == [("empty_file", 0, "")]
    assert faults("source1_entity_id,matched_entity_ids\nS1-1,\n") == [("comma_header", 1, "source1_entity_id,matched_entity_ids")]
    assert [r[0] for r in faults("a\tb\nS1-1\tX\n")] == ["wrong_header"] == [r[0] for r in faults("\n" + head)]
    assert faults(" Source1_Entity_Id \tMATCHED_entity_ids\nS1-1\t\nS1-2\t\nS1-3\t\n") == []
    got = faults(head + "S1-1\tS2-1,S2-1\nS1-1\t \n\nS1-2 S2-1\nS1-9\tS1-1,,S2-7\nS1-3\tS3-1\n", head.replace("matched", "candidate") + "S1-3\tS3-1\nS1-1\tS2-1\n", known=known)
    assert got == [("duplicate_id", 2, "S1-1"), ("duplicate_row", 3, "S1-1"), ("extra_entity", 6, "S1-9"), ("malformed_row", 5, "S1-2 S2-1"), ("missing_entity", 0, "S1-2"), ("self_match", 6, "S1-1"), ("unknown_id", 6, "S2-7"),
                   ("warning_not_a_candidate", 6, ""), ("warning_not_a_candidate", 6, "S1-1"), ("warning_not_a_candidate", 6, "S2-7"), ("wrong_prefix", 6, "")]
    # line numbers hold across the stretches that tasks read
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        many = head + "".join(f"S1-{i}\t\n" for i in range(200)) + "broken\n"
        (tmp_path / "m.tsv").write_text(many)
        lines = rawcheck.numbered_lines(spark, str(tmp_path / "m.tsv"))
        assert [r["value"] for r in lines.orderBy("line").collect()] == many.splitlines() and lines.agg(F.max("line")).first()[0] == 202
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
