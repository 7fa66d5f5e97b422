"""Operators with one right answer, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import automaton, bytescan, chat, decontaminate, ngram_join, packing, quality_rules, secrets, suffix_dedup
from tessera.llm.common import components

WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_rule_counts(spark, edge, none):
    df, rows = edge
    got = Counter((r["row"]["doc_id"], *r["q"][:5]) for r in quality_rules.features(df).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall(WORD, t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)] += 1
    assert got == want
    assert quality_rules.accepted(none).count() == 0


def test_rules_keep_clean_and_drop_junk(spark):
    rng = random.Random(1)
    vocab = [a + b for a in "ba ke li mo nu par sto".split() for b in "da fer gin hol jat kul".split()]
    clean = [(i, " ".join(rng.choice(vocab) for _ in range(200)) + ".") for i in range(80)]
    junk = [(100 + i, " ".join(rng.choice(vocab) + rng.choice(["###", "%%%"]) for _ in range(200))) for i in range(8)] + [(200 + i, " ".join(rng.choice(vocab).upper() + "!!" for _ in range(200))) for i in range(8)]
    df = spark.createDataFrame([(*r, "x") for r in clean + junk], "doc_id long, text string, q string")
    kept = quality_rules.accepted(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in clean}


def test_word_counts_of_the_rules(spark):
    rows = [(i, t) for i, t in enumerate(["AB cd| EF. É ß A1 #x x# # ÀÉ!", "la la la la la lala la\nla x x", "", None, "A" * 9000 + " b" * 3, "漢字 漢字 Ǆ ǅA"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["q"] for r in quality_rules.features(df).collect()}
    for i, t in rows:
        w = re.findall(WORD, t or "")
        q = got[i]
        assert q["n_stutters"] == sum(w[k : k + 3] == w[k + 1 : k + 4] for k in range(len(w) - 3))
        assert q["n_symbol_runs"] == len(re.findall(r"[#*$%&|<>]+", t or "")) and q["n_digit_runs"] == len(re.findall("[0-9]+", t or ""))
        assert q["n_capital_runs"] == sum(len([*g]) > 1 for up, g in itertools.groupby(t or "", str.isupper) if up) and q["n_distinct"] == len(set(w))


def brute_posterior(votes, rounds):
    """Document by document and in plain sums: the same model as the operator's."""
    rules, classes = [*quality_rules.RULES.values()], quality_rules.CLASSES
    start = []
    for v in votes:
        by = Counter(r[0] for r, x in zip(rules, v, strict=True) if x == 0)
        top = max(by.values(), default=0)
        start.append(next(c for c in classes if by[c] == top) if top >= 2 else "good")
    q = [{c: 0.95 if c == s else 0.05 / (len(classes) - 1) for c in classes} for s in start]
    weight = quality_rules.WEIGHT * len(votes) + 1
    for _ in range(rounds):
        share = {c: (sum(x[c] for x in q) + 1) / (len(votes) + len(classes)) for c in classes}
        theta = {}
        for c in classes:
            for j, r in enumerate(rules):
                mean = quality_rules.THOUGHT[0 if c == "good" else 1 if c == r[0] else 2]
                bad = sum(x[c] for x, v in zip(q, votes, strict=True) if v[j] == 0)
                theta[c, j] = (bad + mean * weight) / (bad + sum(x[c] for x, v in zip(q, votes, strict=True) if v[j] == 1) + weight)
        q = []
        for v in votes:
            p = {c: share[c] * math.prod(theta[c, j] if x == 0 else 1 - theta[c, j] for j, x in enumerate(v) if x is not None) for c in classes}
            q.append({c: x / sum(p.values()) for c, x in p.items()})
    return [x["good"] for x in q]


def test_posterior_against_brute_force(spark):
    rng = np.random.default_rng(4)
    kind = [r[0] for r in quality_rules.RULES.values()]
    votes = []
    for _ in range(400):
        junk = rng.choice(quality_rules.CLASSES, p=[0.8, 0.1, 0.05, 0.05, 0.0])
        votes.append(tuple(None if rng.random() < 0.2 else int(rng.random() > (0.7 if k == junk else 0.02)) for k in kind))
    learnt = quality_rules.estimate([*Counter(votes).items()], 30)
    rows = [(i, [None if x is None else float(x) for x in v]) for i, v in enumerate(votes)]
    q = "named_struct('n_words', 100L, 'n_repeat_words', 0L)"
    df = spark.createDataFrame(rows, "i long, v array<double>").withColumn("q", F.expr(q))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "vote", lambda r: F.get("v", F.lit([*quality_rules.RULES].index(r))).cast("int"))
        got = [r["p_good"] for r in quality_rules.judged(df, learnt).orderBy("i").collect()]
    assert np.allclose(got, brute_posterior(votes, 30), atol=1e-6)


def test_one_bad_vote_is_outvoted_and_two_are_not(spark):
    rng = random.Random(2)
    vocab = [a + b for a in "ba ke li mo nu par sto vel".split() for b in "da fer gin hol jat kul".split()]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    clean = [(i, "\n".join(line(12) for _ in range(15))) for i in range(300)]
    twice = [(400 + i, "\n".join([*(line(12) for _ in range(12)), *["share this."] * 7])) for i in range(4)]
    shout = [(500 + i, " ".join(rng.choice(vocab).upper() + "!!" for _ in range(150))) for i in range(25)]
    df = spark.createDataFrame(clean + twice + shout, "doc_id long, text string")
    f = quality_rules.features(df)
    got = {r["row"]["doc_id"]: r for r in quality_rules.judged(f, quality_rules.learn(f)).collect()}
    votes = {r["row"]["doc_id"]: [r[f"v{j}"] for j in range(len(quality_rules.RULES))] for r in f.select("row", *[quality_rules.vote(x).alias(f"v{j}") for j, x in enumerate(quality_rules.RULES)]).collect()}
    assert all(votes[i].count(0) == 1 and got[i]["kept"] for i, _ in twice)
    assert all(votes[i].count(0) >= 2 and not got[i]["kept"] for i, _ in shout) and all(got[i]["kept"] for i, _ in clean)


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[s : s + 10])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in win}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in win:
                    hit |= {*range(s, s + n)}
                    ids |= win[x]
        out.append((len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return Counter(out)


def test_benchmark_hits(spark, edge, none):
    df, rows = edge
    text = dict(r for r in rows if r[0] is not None)
    items = [(1, " ".join(text[20].split()[30:70])), (2, text[31]), (10, "Changed"), (3, None), (4, "--"), (5, "no such words here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in decontaminate.report(df, bench).collect())
    assert got == brute_hits(rows, items)
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x x beta"), (3, "beta alpha beta"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([("alpha", "beta")], "a string, b string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, pairs, 3).collect()} == {1, 3}
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    pairs = [("a", "b"), ("c", "h"), ("g", "e"), ("a", "zz"), ("d", "d"), (None, "a")]
    got = {tuple(r) for r in decontaminate.proximity_matches(docs, spark.createDataFrame(pairs, "a string, b string"), 2).collect()}
    near = lambda t, a, b: any(x == a and b in t[max(0, k - 2) : k + 3] for k, x in enumerate(t))
    assert got == {(i, a, b) for i, t in enumerate([*texts, texts[0]]) for a, b in pairs if a != b and a and near(t.split(), a, b)}


def test_a_hot_term_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT", 7)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(30)] + [(None, "a b a b a b a b a b")]
    items = [(1, "a b a b b a"), (2, "b b b b b b b b b b b b"), (3, " ".join(rows[4][1].split()[10:24])), (4, "a")]
    got = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in got) == brute_hits(rows, items)


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, lower(t))
        s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        if i is not None:
            sets[i] = s
    name = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        before = dict(name)
        for x in ids:
            for y in ids:
                if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    name[x] = name[y] = min(name[x], name[y])
        if name == before:
            break
    return {i: (len(sets[i]), name[i]) for i in ids}


def test_near_duplicates(spark, edge, none):
    df, rows = edge
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_classes(rows)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngram_join.near_duplicates(none).count() == 0


def test_chains_of_near_copies_keep_all_links(spark):
    rng = random.Random(5)
    rows, w = [], [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    for i in range(60):
        rows.append((i, " ".join(w)))
        w = w[3:] + [f"w{rng.randint(0, 10**6)}" for _ in range(3 if i % 7 else 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()} == brute_classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in {(i, t or "") for i, t in rows if i is not None}):
        d = t.encode()
        gone = bytearray(len(d))
        for s in range(len(d) - 99):
            if d[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(d[s : s + 100])
        out[i] = (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("block", "least", "every"), [(1 << 20, 64, 64), (1500, 2, 1), (1500, 1 << 40, 1)])
def test_suffix_dedup(spark, edge, none, block, least, every):
    df, rows = edge
    got = suffix_dedup.digest(suffix_dedup.with_spans(df, block, least, every)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == brute_removed(rows)
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert suffix_dedup.digest(suffix_dedup.with_spans(none)).count() == 0


def test_suffix_array_orders_and_measures():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:520] = data[20:240]
    order, lcp = suffix_dedup.suffix_array(np.concatenate([data, np.zeros(200, np.uint8)]))
    text = data.tobytes() + bytes(200)
    keys = [text[i : i + 100] for i in order]
    assert keys == sorted(keys) and sorted(order) == [*range(700)]
    for j in range(1, 700):
        a, b = keys[j - 1], keys[j]
        assert lcp[j] == next((k for k in range(100) if a[k] != b[k]), 100)


SECRETS = {
    "assign": re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_secrets(t):
    out = []
    for k, (kind, p) in enumerate(SECRETS.items()):
        for m in p.finditer(t):
            if len(m[1] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_secrets_match_regexes():
    rng = random.Random(1)
    parts = ["token", "secret", "passwd", "password", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "==", "deadbeef", "-", ".", "\n", "zzzzzzzzzzzz"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [x for x in secrets.find(t) if x[0] in secrets.BASE] == brute_secrets(t), t


def test_further_secrets(spark):
    t = "ü -----BEGIN RSA PRIVATE KEY----- ghp_" + "aB3" * 13 + " eyJhbGciOiJI." + "x" * 40
    assert [k for k, _, _ in secrets.find(t)] == ["private", "hub", "webtoken"]
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, t, "c")], "doc_id long, text string, secrets string")
    assert sorted(len(r["secrets"]) for r in secrets.scan(df).collect()) == [0, 0, 3]
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_of_long_and_repeated_texts_and_ties(spark):
    long = "word " * 40_000 + "token=0123456789abcdef " + "é" * 50_000 + " AKIA" + "A1" * 9_000
    tie = "AKIA" + "0123456789" * 3  # an access key whose digits are a hexadecimal number too
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, tie), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], [tuple(x) for x in r["secrets"]]) for r in secrets.scan(df).collect()]
    base = lambda spans: [x for x in spans if x[0] in secrets.BASE]
    assert sorted(len(base(x)) for _, x in got) == [0, 2, 3, 3, 3]
    assert all(base(x) == brute_secrets({1: long, None: long, 2: tie, 3: ""}[i]) for i, x in got)


def test_automaton_against_re():
    rng = random.Random(8)
    for p in ["a(b|cd)*e", "[a-c]{2,4}d?", "x[^yz]+y", "(ab){2}|c+"]:
        s = automaton.Scanner([(p, False)])
        for _ in range(300):
            t = "".join(rng.choice("abcdexyz") for _ in range(rng.randint(0, 20))).encode()
            first = re.search(p.encode(), t)
            got = s.scan(t)
            assert bool(first) == bool(got)
            assert all(re.fullmatch(p.encode(), t[a:b]) for _, a, b in got)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s> [\\\\/INST]", "[ROLE:4142] x", "", " a ", "\\", "<s", "[INST"]
    turns = [(r, t) for t in nasty for r in ("user", "assistant", "tool", "", "system")]
    text, mask = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    assert text.count("</s>") == len(mask)


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 0.0), ("t", 5, 2, "user", "d", 0.5), (None, 1, None, "user", None, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"], r["rank"]): [t["text"] for t in r["turns"]] for r in chat.reply_paths(df, 2).collect()}
    assert got == {("t", 4, 1): ["q", "b", "c"], ("t", 5, 2): ["q", "a", "d"], (None, 1, 1): [None]}
    assert chat.reply_paths(df.limit(0)).count() == 0


def test_cycles_and_repeated_nodes(spark):
    nodes = [("t", 1, 2, "a", "x", 1.0), ("t", 2, 1, "b", "y", 1.0), ("t", 3, 1, "c", "z", 9.0), ("t", 9, 9, "c", "self", 9.0), ("t", 4, None, "user", "q", 0.0), ("t", 5, 4, "d", "r", 0.0), ("t", 5, 4, "d", "r", 0.0), ("t", 5, 4, "d", "s", 0.0)]
    nodes += [("big", i, i - 1, "u", str(i), 0.0) for i in range(70)] + [(f"o{k}", i, i - 1, "u", "", None) for k in range(40) for i in range(5)]
    df = spark.createDataFrame([(*n, "k") for n in nodes], "tree string, node long, parent long, role string, text string, score double, leaf string")
    got = {r["tree"]: (r["leaf"], [t["text"] for t in r["turns"]]) for r in chat.reply_paths(df, 5).collect()}
    assert got["t"] == (5, ["q", "r"]) and got["big"] == (69, [str(i) for i in range(70)]) and len(got) == 42
    again = chat.format_paths(chat.reply_paths(df, 5).withColumn("formatted", F.lit(1)))
    assert again.columns.count("formatted") == 1 and dict(again.dtypes)["formatted"] == "string"


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x" * 100_000), (1, None, "assistant", "first"), (None, 0, "assistant", ""), (2, 0, "user", "[/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = chat.reply_paths(chat.as_nodes(df)).withColumnRenamed("tree", "conv_id").select("conv_id", "turns")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_paths(paths), "conv_id").collect()}
    turns = [("assistant", "first"), ("user", ""), ("user", ""), ("", "x" * 100_000)]
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["loss_chars"] == 5 and got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0 and got[2]["n_turns"] == 1
    assert chat.reply_paths(chat.as_nodes(df.limit(0))).count() == 0


def test_packing(spark, edge, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [*edge[1], (8, "a<|endoftext|>b"), (9, "<|endoftext|>" * 3), (9, " <|endoftext|"), (None, "")]
    df = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, start string, `row` int").repartition(2)
    packed = packing.pack(df, path)
    pieces = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
    assert Counter(packing.digest(packed).columns) == Counter("doc_id start length ids_crc32 doc_tokens sequence_id offset".split())
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p["row"]].append(p)
    for k, (i, t) in enumerate(rows):
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(by_row[k], key=lambda p: p["start"]):
            assert (p["doc_id"], p["start"], p["doc_tokens"]) == (i, at, len(ids)) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(none, path).count() == 0


@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["'s", "'LL", " 12", "\u00a0", "\u2003 ", "\r\n\n", "\u0661", "<|endoftext|>", "e\u0301", "\u3000\u4e2d", "\ud7a3"])), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizers_library(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    test_ids_are_those_of_the_tokenizers_library.tok = tok = getattr(test_ids_are_those_of_the_tokenizers_library, "tok", None) or Tokenizer.from_file(path)
    text = "".join(parts)
    assert packing.encoder(path)(text) == tok.encode(text, add_special_tokens=False).ids


def test_cuts_fill_their_classes():
    for n in range(1, 5000):
        c = packing.cuts(n)
        assert sum(c) == n and all(x <= 1024 for x in c)
        assert all(x == 1024 // (1024 // x) for x in c if x >= packing.LEAST)


def test_hashes_depend_on_content_alone():
    a, b = (bytescan.shingles(*[(d, o) for _, _, d, o in bytescan.blocks(pa.array(x))][0]) for x in (["A b  c d e f"], ["x y", "a B c\nd E f"]))
    assert set(a[1].tolist()) == {h for t, h in zip(*(x.tolist() for x in b), strict=True) if t == 1} and len(b[1]) == 3


def test_blocks_hold_whole_texts():
    texts = ["a" * 50, None, "", "b" * 500, "cc"] * 3
    seen = []
    for at, n, data, off in bytescan.blocks(pa.array(texts, pa.string()).slice(1), 100):
        seen += [bytes(data[s:e]).decode() for s, e in zip(off[:-1], off[1:], strict=True)]
        assert at + n <= 14
    assert seen == [t or "" for t in texts[1:]]
