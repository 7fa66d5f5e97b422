"""Hard negatives, token files and the Merkle manifest, against brute force."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import idcoder, merkle, negatives, suffix_dedup, tokenbin


def brute_negatives(rows, is_anchor, positives=5, negatives_=10, low=30, high=90):
    rows = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, lab, v in rows:
        if not is_anchor(i):
            continue
        near = sorted((-dot(v, w), j) for j, other, w in rows if other == lab and j != i)[:positives]
        for s, j in near:
            ps = -s
            fit = sorted((-dot(v, w), k) for k, other, w in rows if other != lab and low * ps <= 100 * dot(v, w) <= high * ps)[:negatives_]
            for r, (ns, k) in enumerate(fit, 1):
                out[i, j, r, k, ps, -ns] += 1
    return out


def vectors(seed):
    rng = random.Random(seed)
    point = lambda: [rng.gauss(0, 0.3) for _ in range(8)]
    common = point()
    rows = [(i, point(), rng.randrange(4)) for i in range(-40, 150)]
    rows += [(200 + i, common, i % 3) for i in range(90)]  # ties that only ids decide
    rows += [(1000, None, 1), (1010, point(), None), (None, point(), 1), (1020, [None] + point()[1:], 1), (1030, [float("nan")] + point()[1:], 1), (1040, [float("inf")] + point()[1:], 1), (1050, [], 1), (1060, point()[:3], 2)]
    return rows + rows[60:64] + [(10, point(), 3)]  # repeated rows, and a repeated id


@pytest.mark.parametrize(("most", "gather"), [(32 << 20, 4), (0, 1)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, most, gather):
    monkeypatch.setattr(negatives, "BROADCAST", most)
    monkeypatch.setattr(negatives, "GATHER", gather)
    monkeypatch.setattr(negatives, "BLOCK", 8)
    monkeypatch.setattr(negatives, "TILE", 50)
    rows = vectors(3)
    df = spark.createDataFrame(rows, "id long, x array<float>, label int").withColumn("score", F.lit("clash")).repartition(3)
    q = negatives.quantized(df, F.col("id"), F.col("x"), F.col("label"))
    got = Counter(tuple(r) for r in negatives.hard_negatives(q, F.col("id") % 10 == 0).collect())
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got == brute_negatives(as_float, lambda i: i % 10 == 0) and len(got) > 500


def test_hard_negatives_of_large_numbers_and_of_nothing(spark):
    rng = random.Random(5)
    rows = [(i * 10**17, [rng.uniform(-1e6, 1e6) for _ in range(4)], i % 2) for i in range(-40, 41)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    got = Counter(tuple(r) for r in negatives.hard_negatives(negatives.quantized(df, F.col("id"), F.col("x"), F.col("label")), F.col("id") >= 0, positives=2, negatives=3).collect())
    assert got == brute_negatives(rows, lambda i: i >= 0, 2, 3) and got
    for none in (df.limit(0), df.where("id < 0")):
        q = negatives.quantized(none, F.col("id"), F.col("x"), F.col("label"))
        out = negatives.hard_negatives(q, F.col("id") >= 0)
        assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), min_size=1, max_size=60), min_size=1, max_size=9), st.integers(1, 4))
def test_coder_round_trip(lists, times):
    for wide in (True, False):
        blocks = [np.array(x * times, np.uint32) & (0xFFFFFFFF if wide else 0xFFFF) for x in lists]
        coded = idcoder.encode(blocks, wide)
        back = idcoder.decode(coded, [len(b) for b in blocks], wide)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
        # a block's bytes do not depend on what is coded beside it
        assert coded[0] == idcoder.encode(blocks[:1], wide)[0]


def test_coder_learns():
    rng = np.random.default_rng(1)
    often = rng.zipf(1.5, 2048).clip(0, 60000).astype(np.uint32)
    again = np.tile(rng.integers(0, 60000, 64).astype(np.uint32), 32)
    flat = rng.integers(0, 65536, 2048).astype(np.uint32)
    a, b, c = (8 * len(x) / 2048 for x in idcoder.encode([often, again, flat], False))
    assert a < 6 and b < 1.2 and 16 <= c < 16.6


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    import public_tokenizers

    path, rng = public_tokenizers.path(name), random.Random(7)
    odd = ["J̌ Áb'S isn't O'Neil's,x ,y .A,B. É, ﬁ ﬀ,", "<|endoftext|>a", "<|STARTOFTEXT|> x, y", "Σας ΟΔΟΣ, İx Kelvin K", None, "", "\n\n", " lead", "trail ", "a b,c\x1cd\x85e f", "don't,won't; 'sometimes' ''s ('s x.'s 12,345.6 a1,b2", "한국어, 漢字。日本", "x" * 30000, "la, " * 20000]
    odd += ["".join(rng.choice("aAjJ̌́ .,'sS\n\t<|!?;:1é‍漢Σ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    t = tokenbin.Tokenizer(path)
    ids, n = t.ids(pa.array(odd), 2)
    want = [[*x, 2] for x in library(path, [o or "" for o in odd])]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert t.by_word == (name == "word_bpe_49k.json")


def test_token_files(spark, edge, none, tmp_path, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokenbin, "FILE_BYTES", 20_000)
    df, rows = edge
    df = df.withColumns({"file": F.lit("clash"), "tie": F.lit("clash")})
    tokenbin.write_ids(df, str(tmp_path / "x"), path)
    found = tokenbin.read_ids(spark, str(tmp_path / "x"))
    got = found.orderBy("file", "place").collect()
    assert len({r["file"] for r in got}) > 2
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = [(i, np.array([*x, 2], "<u4").tobytes()) for (i, _), x in zip(rows, library(path, [t or "" for _, t in rows]), strict=True)]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter(want)
    at = 0
    for r in tokenbin.digest(found).orderBy("start").collect():
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == sum(len(b) // 4 for _, b in want)
    assert sorted(r["ids_crc32"] for r in tokenbin.digest(found).collect()) == sorted(zlib.crc32(b) for _, b in want)
    tokenbin.write_ids(none, str(tmp_path / "none"), path)
    assert tokenbin.digest(tokenbin.read_ids(spark, str(tmp_path / "none"))).collect() == []


def test_damaged_files_are_found():
    ids = np.arange(5000, dtype=np.uint32) % 300
    count = np.array([1200, 1, 3799])
    data = b"".join(b + b"\n" for b in tokenbin.blocks(4, 0, np.array([5, 0, 9]), np.array([False, True, False]), count, ids))
    file, rows, back = tokenbin.decoded(memoryview(data))
    assert file == 4 and np.array_equal(back, ids) and rows["n"].tolist() == [1200, 1, 3799] and rows["none"].tolist() == [0, 1, 0]
    rng = random.Random(2)
    for at in [0, 4, 9, 30, len(data) - 2, *rng.sample(range(len(data) - 1), 40)]:
        if data[at] == 10:
            continue
        with pytest.raises(ValueError, match="block|ids"):
            tokenbin.decoded(memoryview(data[:at] + bytes([data[at] ^ 64]) + data[at + 1 :])) if data[at : at + 1] != b"\n" else None
    with pytest.raises(ValueError, match="block"):
        tokenbin.decoded(memoryview(data[:-40]))


def test_new_words_need_merges_alone(monkeypatch):
    import public_tokenizers

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    words = ["".join(rng.choice("aeinrstßéñüŵ") for _ in range(rng.randint(1, 22))) for _ in range(20000)]
    words += ["".join(rng.choice("ab'tsrevldm019-_%&.,") for _ in range(rng.randint(1, 12))) for _ in range(20000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    t, want = tokenbin.Tokenizer(path), [i for x in library(path, texts) for i in [*x, 2]]
    monkeypatch.setattr(t, "encode", None)  # the library's pipeline, which takes ten times as long a word
    assert t.ids(pa.array(texts), 2)[0].tolist() == want
    monkeypatch.setattr(t, "words", None)  # known by now
    assert t.ids(pa.array(texts), 2)[0].tolist() == want


def test_files_are_decoded_together():
    rng, files = np.random.default_rng(4), []
    for file, most in ((0, 900), (1, 2**20), (2, 3)):
        ids = rng.integers(0, most, 5000).astype(np.uint32)
        files.append((file, ids, b"".join(b + b"\n" for b in tokenbin.blocks(file, 0, np.array([file]), np.array([False]), np.array([5000]), ids))))
    found = tokenbin.decoded_together([memoryview(data) for _, _, data in files])
    assert [f for f, _, _ in found] == [0, 1, 2] and all(np.array_equal(got, ids) for (_, _, got), (_, ids, _) in zip(found, files, strict=True))


def brute_manifest(rows, claim):
    """{(doc_id, leaf): results} by the definition, level by level."""
    h = lambda *x: sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i - i % 3
            yield level[a:i], level[i + 1 : a + 3]
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(claim(r))))
    trees = {s: tree([x[2] for x in sorted(v)]) for s, v in by.items()}
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in sources])
    out = Counter()
    for k, s in enumerate(sources):
        for i, (known, doc_id, own, claimed) in enumerate(sorted(by[s])):
            p = [*path(trees[s], i), *path(top, k)]
            f = claimed
            for a, b in p:
                f = h(*a, f, *b)
            out[doc_id if known else None, own, trees[s][-1][0], top[-1][0], h(*(x for a, b in p for x in [*a, *b])), f, f == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("bucket", [4096, 2])
def test_manifest_against_brute_force(spark, bucket):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé漢\n") for _ in range(rng.randint(0, 6)))
    rows = [(rng.choice([i, i * 7919, -i, i << 40]), rng.choice(["s", "s", "s", "t", None]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([word(), None])) for i in range(230)]
    rows += [(i, f"u{i}", "en", 1, word()) for i in range(14)] + [(77, "one", "en", 2, "x\ny" * 5000)]
    rows += [(None, "s", "en", 1, "a\n"), (None, None, None, None, None), (3, "", "", 0, "")] + rows[:6] * 3 + [(5, "s", "en", 1, f"v{i}\n") for i in range(9)]
    claim = lambda r: (*r[:4], r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"grp": F.lit("clash"), "rank": F.lit(1)}).repartition(4)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = merkle.leaf([text if c == "text" else F.col(c) for c in merkle.COLUMNS])
    made = merkle.manifest(df, bucket=bucket, depth=2, claimed=claimed)
    want = brute_manifest(rows, claim)
    assert Counter(tuple(r) for r in merkle.audit(made, "claimed").collect()) == want
    assert {True, False} == {k[-1] for k in want}
    for r in made.proofs().collect():
        assert merkle.fold(r["leaf"].encode(), [(bytes(p["left"]), bytes(p["right"])) for p in r["path"]]).decode() == made.root
    assert {(r["source"], r["subroot"]) for r in made.subroots.collect()} == {(s, k[2]) for k in want for s in [next(x[1] for x in rows if x[0] == k[0] and k[1] == sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in x).encode()).hexdigest())]}


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema))
    assert one.root == sha256(b"1:1----").hexdigest() and one.proofs().first()["path"] == []
    none = merkle.manifest(spark.createDataFrame([], schema))
    assert none.root is None and none.proofs().collect() == [] and none.subroots.collect() == []


def test_texts_of_one_doc_id_are_cut_apart(spark):
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    x, unique = some(400), some(400)
    rows = [(1, x), (2, x), (2, unique), (2, x), (3, unique[100:300] + some(50)), (None, x), (4, None), (4, "short")]
    got = suffix_dedup.with_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    gone = {(r["doc_id"], r["text"]): [tuple(s) for s in r["spans"] or []] for r in got}
    assert len(got) == len(rows) and gone[2, unique] == [] == gone[1, x] == gone[None, x] == gone[4, None] == gone[4, "short"]
    assert gone[2, x] == [(0, 400)] and gone[3, rows[4][1]] == [(0, 200)]
