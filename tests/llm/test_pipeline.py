import random

import corpus_pipeline as P


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(6)
    vocab = [a + b for a in "ba ke li mo nu par sto tri vel".split() for b in "da fer gin hol jat kul mer".split()]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    clean = {i: text(90) + "\n" + text(90) for i in range(40)}
    leak = text(40)
    docs = dict(clean)
    for i in range(0, 20):
        docs[i] += "\nThis page was printed for you by the friendly press of our town."
    docs |= {100: clean[3], 101: clean[3] + " more", 102: clean[30].replace(vocab[0], "x", 1)}
    docs |= {200: text(60) + " " + leak + " " + text(60), 300: " ".join(w + "###" for w in text(90).split()), 301: "too short"}
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        kept = P.stored(stage(spark, kept, sf))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append((name, {r["doc_id"] for r in kept.collect()}))
    everything = set(docs)
    assert seen[0][1] == everything - {300, 301} and seen[1][1] == seen[0][1]
    assert seen[2][1] == seen[1][1] - {100, 101, 102}
    assert seen[3][1] == seen[2][1] - {200} == set(clean)
    final = {r["doc_id"]: r for r in kept.collect()}
    assert all(r["text"] == clean[i] and r["n_chars"] == len(clean[i]) for i, r in final.items())
    pieces = P.run(spark, sf).collect()
    assert {p["doc_id"] for p in pieces} == set(clean)
    assert P.rules(spark, kept.limit(0), sf).count() == 0


def test_stages_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    vocab = [a + b for a in "ba ke li mo nu par sto tri vel".split() for b in "da fer gin hol jat kul mer".split()]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    leak, own, same = text(40), text(90), text(90)
    long = "\n".join(" ".join("".join(rng.choice("abdegiklmnorstu") for _ in range(6)) for _ in range(40)) + "." for _ in range(500))
    rows = [(1, own), (1, own), (2, None), (3, ""), (None, text(80)), (None, f"{text(30)} {leak} {text(30)}"), (None, None), (4, same), (5, same), (6, f"{text(60)} {leak}"), (7, long)]
    names = "doc_id long, text string, n_chars long, n_lines int, row string, `__gone` int, mark int, entities string, kept int, label int"
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, 3, "y", 4, 5) for r in rows], names)
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {(1, "x", 2, 3, "y", 4, 5)}
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert key(P.rules(spark, df, "")) == sorted([r for r in rows if r[1]], key=str)
    assert key(P.lines(spark, df, "")) == sorted(rows, key=str)
    assert key(P.near_duplicates(spark, df, "")) == sorted([r for r in rows if r[0] != 5][1:], key=str)
    assert key(P.benchmark_leaks(spark, df, str(tmp_path))) == sorted([r for r in rows if leak not in (r[1] or "")], key=str)
    pieces = P.pack(spark, df, "").collect()
    assert sum(p["start"] == 0 for p in pieces) == len(rows) and P.pack(spark, df.limit(0), "").count() == 0
