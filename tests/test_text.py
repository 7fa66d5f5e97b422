from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X


def rows(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", f(F.col("x")).alias("y")).collect())]


def test_names(spark):
    names = ["Café  & Co., Ltd", "La La Land", "www.My-Shop.com", "my shop .com", "STRASSE Straße", "कमल प्रेस", "", None]
    got = rows(spark, names, X.norm_name)
    assert [g["name"] for g in got[:5]] == ["cafe and co ltd", "la land", "wwwmyshop", "my shop com", "strasse"]
    assert [g["is_domain"] for g in got[:4]] == [False, False, True, False]
    assert got[5]["name"].split(" ")[0] == "कमल" and got[6]["name"] == ""


def test_addresses(spark):
    got = rows(spark, ["007 Main St., N/A, null, 000 Būlvāris", "-, --", "Flat 0, 12 12 Rd"], X.norm_addr)
    assert got == ["7 main st 0 bulvaris", "", "flat 0 12 12 rd"]


def test_fold_lowers_before_it_decomposes(spark):
    assert rows(spark, ["É™", "ﬁne Œuvre"], X.fold_exact) == ["eTM", "fine oeuvre"]
    assert rows(spark, ["ÉÀ Ø Þ đ​x"], X.fold) == ["ea o th dx"]


def test_fold_is_exact(spark):
    texts = ["ﬁne™ Ⅻ ½ Ǆ", "क़लम 각하 ﷺ", "𝐀𝒷 ℡ ﬃ", "İSTANBUL ÀØÞ", "plain"]
    want = ["".join(map(X._fold_char, t.lower())) for t in texts]
    assert rows(spark, texts, X.fold) == want and want[0] == "fineTM xii 1⁄2 dz"
    assert rows(spark, ["ﬁne Œuvre™"], lambda c: X.norm_name(c)["name"]) == ["fine oeuvre"]


def test_leet(spark):
    assert rows(spark, ["5hop", "c4fe", "4411", "21st", "b3st"], X.leet) == ["shop", "cafe", "4411", "21st", "best"]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def naive_ratio(a, b):
    return 200 * brute_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def naive_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 100.0 if a == b else 0.0
    both, one, two = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    one, two = f"{both} {one}".strip(), f"{both} {two}".strip()
    if both and both in (one, two):
        return 100.0
    return max([naive_ratio(one, two)] + ([naive_ratio(both, one), naive_ratio(both, two)] if both else []))


def naive_partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    return max(naive_ratio(a, b[max(k, 0) : k + len(a)]) for k in range(1 - len(a), len(b)))


def naive_jaro(a, b):
    if a == b or not a or not b:
        return float(a == b)
    reach, taken, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            hits.append(c)
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(hits, sorted(taken), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


NAIVE = {
    "ratio": naive_ratio, "tsort": lambda a, b: naive_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), "tset": naive_set, "partial": naive_partial,
    "ptset": lambda a, b: 100.0 if set(a.split()) & set(b.split()) else naive_partial(" ".join(sorted(set(a.split()))), " ".join(sorted(set(b.split())))), "jw": naive_jaro,
}


def test_kernels_are_what_loops_give():
    import random

    rng = random.Random(4)
    draw = lambda: "".join(rng.choice("abcd e\u0915" if rng.random() < 0.2 else "abc ") for _ in range(rng.choice([0, 1, 3, 9, 20, 63, 64, 65, 90])))
    a, b = [draw() for _ in range(300)], [draw() for _ in range(300)]
    b[:40] = [x[::-1] for x in a[:40]]
    b[40:80] = [x[:5] + "z" + x[5:] for x in a[40:80]]
    for name, f in NAIVE.items():
        k = 300 if name not in ("partial", "ptset") else 120
        assert S.KERNELS[name](a[:k], b[:k]).round(9).tolist() == [round(f(x, y), 9) for x, y in zip(a[:k], b[:k], strict=True)], name
    assert all(len(f([], [])) == 0 for f in S.KERNELS.values())


def test_kernels_at_the_edges():
    one = lambda f, a, b: f([a], [b])[0]
    assert one(S.ratio, "", "") == 100 and one(S.ratio, "a", "") == 0
    assert one(S.token_set, "new york pizza", "pizza york new house") == 100
    assert one(S.partial, "abc", "xxabcxx") == 100
    assert one(S.partial_token_set, "a b", "b c") == 100
    assert round(one(S.jaro_winkler, "martha", "marhta"), 4) == 0.9611 and one(S.jaro_winkler, "", "") == 1


def test_kernels_run_in_one_crossing(spark):
    df = spark.createDataFrame([("ab cd", "cd ab"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(S.kernels(F.col("a"), F.col("b"), "ratio", "tsort")).collect()]
    assert got[0]["tsort"] == 100 and got[1]["ratio"] == 0
