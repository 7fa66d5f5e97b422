import random

import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, tiny, repetitive and very long texts, exact and near copies, repeated rows."""
    rng = random.Random(11)
    vocab = [a + b for a in "ba ke li mo nu par sto tri vel zan".split() for b in "da fer gin hol jat kul mer nos".split()]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(120) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One\ntwo"), (5, "la la la " * 60), (6, text(9000)), (None, text(80)), (None, None), (7, "É ﬁ 漢字 " * 30)]
    for i, b in enumerate(base):
        w = b.split()
        rows += [(10 + 10 * i, b), (11 + 10 * i, b.upper()), (12 + 10 * i, " ".join([*w[:60], "changed", *w[61:]])), (13 + 10 * i, " ".join(w[:60] + text(60).split())), (14 + 10 * i, b + "\n" + base[(i + 1) % 6])]
    rows += [(10, base[0]), (3, "one")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
