"""Gradient-boosted trees that grow leaf by leaf, learn where missing values go, and keep to monotone directions.

Rows are binned once and stored as matrices. A pass over them adds up gradients by node, feature and bin: counts that a
shuffle sums and that are as many as the bins, whatever the rows. The driver sees these sums and chooses splits.

Best-first growth needs one split after another, but not one pass after another: a node's gain does not depend on when it
is split. So each pass opens all nodes that best-first growth would open as far as it can be foreseen, and when it can
be followed to its end within what is known, the tree is the one that single steps would give. Passes are about as many as the tree is deep.

Gradients are added up as whole numbers, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stored import stored

#: Rows of a stored matrix; whole numbers to 1 of a gradient.
CHUNK, UNIT = 32768, 1 << 24
#: Trees after which the rows' scores are written anew; in between a pass evaluates the trees since then.
REWRITE = 16


@dataclass(frozen=True)
class Settings:
    """``monotone``: feature -> 1 (rising) or -1. ``patience``: rounds without a gain on held rows until training ends."""

    rounds: int = 100
    leaves: int = 31
    rate: float = 0.1
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 1.0
    bins: int = 255
    row_share: float = 1.0
    feature_share: float = 1.0
    patience: int = 30
    seed: int = 1
    monotone: dict[str, int] = field(default_factory=dict)


class Tree:
    """Nodes as parallel lists: feature (-1: leaf), bin (values of it and below go left), whether missing goes left, children, value, gain, rows."""

    def __init__(self):
        self.feature, self.bin, self.missing, self.left, self.right, self.value, self.gain, self.rows = ([] for _ in range(8))

    def add(self, value: float, rows: int) -> int:
        for c, x in ((self.feature, -1), (self.bin, 0), (self.missing, False), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            c.append(x)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.missing, self.left, self.right, self.value))


def route(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``bins`` (0: missing)."""
    feature, at, missing, left, right, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(rows):
        n = node[rows]
        b = bins[rows, feature[n]]
        node[rows] = np.where(np.where(b == 0, missing[n], b <= at[n]), left[n], right[n])
        rows = rows[feature[node[rows]] >= 0]
    return node


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin 0 for missing, else 1 and how many cuts are below the value."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j]) + 1)
    return out


@dataclass
class Boosted:
    """A model: ``transform`` gives the probability of label 1. ``losses``: of the held rows after 0, 1, ... trees."""

    names: tuple[str, ...]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features in order, missing as NaN."""
        bins, score = _binned(x, self.cuts), np.full(len(x), self.base)
        for t in self.trees:
            a = t.arrays()
            score += a[5][route(a, bins)]
        return 1 / (1 + np.exp(-score))

    def transform(self, rows: DataFrame, column: str = "p") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.probability(np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], 1)))

        return rows.withColumn(column, run(*[F.col(n).cast("double") for n in self.names]))

    def gains(self) -> list[tuple[str, float]]:
        """Features by the gain of their splits."""
        total = dict.fromkeys(self.names, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.names[f]] += g
        return sorted(total.items(), key=lambda x: -x[1])

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "cuts": [c.tolist() for c in self.cuts], "base": self.base, "losses": self.losses, "trees": [t.__dict__ for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        trees = []
        for one in d["trees"]:
            t = Tree()
            t.__dict__.update(one)
            trees.append(t)
        return cls(tuple(d["names"]), [np.array(c) for c in d["cuts"]], d["base"], trees, d["losses"])


def cut_points(rows: DataFrame, names: tuple[str, ...], bins: int) -> list[np.ndarray]:
    """Upper bounds of each feature's bins but the last: quantiles, or all values if they are few."""
    ranks = [i / (bins - 1) for i in range(bins)]
    found = rows.select(*[F.nanvl(F.col(n).cast("double"), F.lit(None)).alias(n) for n in names]).approxQuantile(list(names), ranks, 0.25 / bins)
    return [np.unique(q)[:-1] for q in found]


def _packed(rows: DataFrame, names: tuple[str, ...], cuts: list[np.ndarray]) -> DataFrame:
    """(part, bins, label, held, score): rows as matrices of bins; score, the sum of the trees so far, is still empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                x = np.stack([b.column(j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(2, b.num_columns)], 1)
                marks = [np.asarray(b.column(j).to_numpy(zero_copy_only=False), np.uint8).tobytes() for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([part]), *[pa.array([v], pa.binary()) for v in (_binned(x, cuts).tobytes(), *marks, b"")]], ["part", "bins", "label", "held", "score"])
                part += 1

    data = rows.select(F.col("label").cast("byte"), F.col("held").cast("byte"), *[F.col(n).cast("double").alias(n) for n in names])
    return data.mapInArrow(run, "part long, bins binary, label binary, held binary, score binary")


def _chunk(row: dict, width: int, base: float, trees: list) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, width)
    score = np.frombuffer(row["score"]) + 0.0 if row["score"] else np.full(len(bins), base)
    for t in trees:
        score += t[5][route(t, bins)]
    return bins, np.frombuffer(row["label"], np.uint8), np.frombuffer(row["held"], np.uint8), score


def _sums(data: DataFrame, width: int, base: float, trees: list, tree: tuple, targets: list[int], features: np.ndarray, bag: tuple[int, float], loss: bool) -> pd.DataFrame:
    """(node, feature, bin, g, h, n) of the learning rows that ``tree`` routes to ``targets``; and, as node -1, the held rows' loss (g) and number (n)."""
    column = np.full(len(tree[0]), -1)
    column[targets] = np.arange(len(targets))
    seed, share = bag

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        lost, held_rows = 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                bins, label, held, score = _chunk(row, width, base, trees)
                if total is None:
                    total = np.zeros((len(targets), len(features), 256, 3), np.int64)
                p = 1 / (1 + np.exp(-score))
                if loss and held.any():
                    q, y = p[held == 1], label[held == 1]
                    lost += int(np.rint(-np.log(np.clip(np.where(y, q, 1 - q), 1e-15, 1)) * UNIT).sum())
                    held_rows += len(q)
                use = held == 0
                if share < 1:
                    use &= np.random.Generator(np.random.Philox(key=[seed, row["part"]])).random(len(use)) < share
                at = np.flatnonzero(use)
                where = column[route(tree, bins[at])]
                at, where = at[where >= 0], where[where >= 0]
                if not len(at):
                    continue
                g, h = np.rint((p[at] - label[at]) * UNIT), np.rint(p[at] * (1 - p[at]) * UNIT)
                size = len(targets) * 256
                for j, f in enumerate(features):
                    key = where * 256 + bins[at, f]
                    # sums of whole numbers below 2**53: exact
                    for c, weights in enumerate((g, h, None)):
                        total[:, j, :, c] += np.bincount(key, weights, size).astype(np.int64).reshape(-1, 256)
        if total is not None:
            node, feature, b = np.nonzero(total[..., 2])
            values = total[node, feature, b]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(targets)[node].astype(np.int32), features[feature].astype(np.int32), b.astype(np.int32), *np.ascontiguousarray(values.T))], names)
        if held_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([v], k)) for v, k in ((-1, np.int32), (-1, np.int32), (0, np.int32), (lost, np.int64), (0, np.int64), (held_rows, np.int64))], names)

    names = ["node", "feature", "bin", "g", "h", "n"]
    each = data.mapInArrow(run, "node int, feature int, bin int, g long, h long, n long")
    return each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()


def best_split(sums: np.ndarray, s: Settings, signs: np.ndarray, low: float, high: float, allowed: np.ndarray) -> dict | None:
    """The split of most gain of a node with ``sums`` (feature, bin, (g, h, n)); values stay within [low, high] and rise or fall by ``signs``.

    Missing values (bin 0) are tried on both sides. None if nothing is gained.
    """
    every = sums[allowed[0]].sum(0)
    value = lambda g, h: np.clip(-g / np.maximum(h + s.l2, 1e-12), low, high)
    score = lambda g, h, v: -(2 * g * v + (h + s.l2) * v * v)
    parent = float(score(every[0], every[1], value(every[0], every[1])))
    best = None
    below = np.cumsum(sums[allowed, 1:-1], 1)  # values of bin 1, 1..2, ... go left
    for missing_left in (True, False):
        left = below + sums[allowed, :1] if missing_left else below
        right = every - left
        vl, vr = value(left[..., 0], left[..., 1]), value(right[..., 0], right[..., 1])
        gain = score(left[..., 0], left[..., 1], vl) + score(right[..., 0], right[..., 1], vr) - parent
        bad = (left[..., 2] < s.least_rows) | (right[..., 2] < s.least_rows) | (left[..., 1] < s.least_hessian) | (right[..., 1] < s.least_hessian) | (signs[allowed, None] * (vr - vl) < 0)
        gain = np.where(bad, -np.inf, gain)
        if not missing_left:
            gain[sums[allowed, 0, 2] == 0] = -np.inf  # without missing rows both are one
        k = int(np.argmax(gain))
        j, b = divmod(k, gain.shape[1])
        if gain[j, b] > 1e-9 and (best is None or gain[j, b] > best["gain"]):
            best = {"gain": float(gain[j, b]), "feature": int(allowed[j]), "bin": b + 1, "missing": missing_left, "left": left[j, b], "right": right[j, b], "values": (float(vl[j, b]), float(vr[j, b]))}
            if not sums[allowed[j], 0, 2]:  # no missing rows here: later ones go with the greater side
                best["missing"] = bool(left[j, b, 2] >= right[j, b, 2])
    return best


def _grow(sums_of, s: Settings, signs: np.ndarray, width: int, allowed: np.ndarray, root: np.ndarray) -> Tree | None:
    """The tree that best-first growth from ``root`` gives; ``sums_of(tree, targets)`` makes a pass."""
    tree, hist, split, bounds = Tree(), {0: root}, {}, {0: (-np.inf, np.inf)}
    total = root[allowed[0]].sum(0)
    tree.add(float(-total[0] / max(total[1] + s.l2, 1e-12)), int(total[2]))
    split[0] = best_split(root, s, signs, *bounds[0], allowed)
    while True:
        leaves, missing = [0], []
        for _ in range(s.leaves - 1):
            able = [n for n in leaves if split.get(n) and n not in missing]
            if not able:
                break
            top = max(able, key=lambda n: (split[n]["gain"], -n))
            if tree.feature[top] >= 0:
                leaves.remove(top)
                leaves += [tree.left[top], tree.right[top]]
            else:
                missing.append(top)
        if not missing:
            break
        small = {}
        for n in missing:
            x = split[n]
            low, high = bounds[n]
            middle = sum(x["values"]) / 2
            sign = signs[x["feature"]]
            tree.feature[n], tree.bin[n], tree.missing[n], tree.gain[n] = x["feature"], x["bin"], x["missing"], x["gain"]
            for side, v in zip(("left", "right"), x["values"], strict=True):
                child = tree.add(v, int(x[side][2]))
                getattr(tree, side)[n] = child
                first = (side == "left") == (sign > 0)
                bounds[child] = (low, high) if not sign else (low, middle) if first else (middle, high)
            l, r = tree.left[n], tree.right[n]
            small[n] = l if x["left"][2] <= x["right"][2] else r
        found = sums_of(tree, sorted(small.values()))
        for n, child in small.items():
            other = tree.left[n] + tree.right[n] - child
            hist[child] = found[child]
            hist[other] = hist.pop(n) - found[child]
            for c in (child, other):
                split[c] = best_split(hist[c], s, signs, *bounds[c], allowed)
    # what was opened and not chosen is closed again
    keep, out = {*leaves}, Tree()
    if leaves == [0]:
        return None

    def copy(n: int) -> int:
        k = out.add(tree.value[n] * s.rate, tree.rows[n])
        if n not in keep:
            out.feature[k], out.bin[k], out.missing[k], out.gain[k] = tree.feature[n], tree.bin[n], tree.missing[n], tree.gain[n]
            out.left[k], out.right[k] = copy(tree.left[n]), copy(tree.right[n])
        return k

    copy(0)
    return out


def fit(rows: DataFrame, names: tuple[str, ...], s: Settings = Settings(), label: str = "label", held: str | None = None) -> Boosted:
    """Learns ``label`` (0 or 1) from ``names``. Rows where ``held`` is true are not learnt; their loss ends training after ``patience`` rounds
    without a gain, and the trees up to the best round are kept. Missing values are null or NaN.
    """
    data = rows.withColumns({"label": F.col(label).cast("byte"), "held": F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)})
    learn = data.where("not held")
    cuts = cut_points(learn, names, s.bins)
    data = stored(_packed(data, names, cuts))
    width, signs = len(names), np.array([s.monotone.get(n, 0) for n in names])
    rng = np.random.default_rng(s.seed)
    positive, n = learn.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    base = float(np.log((positive + 1e-6) / (n - positive + 1e-6))) if n else 0.0
    model, recent, best = Boosted(names, cuts, base, []), [], 0
    has_held = bool(held) and not rows.where(F.col(held)).isEmpty()
    for turn in range(s.rounds + 1):
        features = np.sort(rng.permutation(width)[: max(1, round(s.feature_share * width))])
        bag = (int(rng.integers(1 << 62)), s.row_share)

        def sums_of(tree: Tree, targets: list[int], loss: bool = False, features=features, bag=bag) -> dict[int, np.ndarray]:
            found = _sums(data, width, base, [t.arrays() for t in recent], tree.arrays(), targets, features, bag, loss)
            out = {t: np.zeros((width, 256, 3)) for t in targets}
            for t in targets:
                own = found[found["node"] == t]
                out[t][own["feature"], own["bin"]] = own[["g", "h", "n"]].to_numpy(np.float64) / [UNIT, UNIT, 1]
            if loss and (found["node"] == -1).any():
                r = found[found["node"] == -1].iloc[0]
                model.losses.append(float(r["g"]) / UNIT / float(r["n"]))
            return out

        start = Tree()
        start.add(0.0, 0)
        root = sums_of(start, [0], loss=True)[0]
        if has_held:
            best = int(np.argmin(model.losses))
            if len(model.losses) - 1 - best >= s.patience:
                break
        if turn == s.rounds or not n:
            break
        tree = _grow(sums_of, s, signs, width, features, root)
        if tree is None:
            break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) >= REWRITE:
            data, recent = stored(_rescored(data, width, base, [t.arrays() for t in recent])), []
    if has_held:
        model.trees = model.trees[:best]
    return model


def _rescored(data: DataFrame, width: int, base: float, trees: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_chunk(row, width, base, trees)[3].tobytes() for row in batch.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(scores, pa.binary()))

    return data.mapInArrow(run, data.schema)
