"""String kernels that Spark lacks, in one Arrow crossing: every kernel of a pair comes from one struct.

Kernels take whole batches of pairs. ratio is 200 * LCS / (len1 + len2); the longest common subsequences of a
batch advance together, one character of the longer strings at a time, the shorter ones being the bits of a
64-bit word each. Two empty strings are equal (100; Jaro-Winkler 1), one empty string shares nothing (0).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that advance together, of similar lengths.
BATCH = 2048
WORD = 64
#: Different characters of a batch, up to which the windows of its pairs slide together.
ALPHABET = 512


def lcs(a: str, b: str) -> int:
    """One pair of any length, by an integer of as many bits as ``a`` has characters."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _lengths(x: list[str]) -> np.ndarray:
    return np.fromiter(map(len, x), np.int64, len(x))


def _padded(x: list[str], n: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Code points by row; ``pad`` (1 or 2) counts down from the largest number, which no text holds."""
    data = np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full((len(x), width), 2**32 - pad, np.uint32)
    out[np.arange(width) < n[:, None]] = data
    return out


def _narrow(a: np.ndarray, b: np.ndarray, ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
    return (a.astype(np.uint8), b.astype(np.uint8)) if ascii_only else (a, b)


def _batches(a: list[str], b: list[str], by: np.ndarray):
    order = np.argsort(by, kind="stable")
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        x, y = [a[i] for i in rows], [b[i] for i in rows]
        yield rows, x, y, "".join(x).isascii() and "".join(y).isascii()


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    na, nb = _lengths(a), _lengths(b)
    out = np.zeros(len(a), np.int64)
    for i in np.flatnonzero(na > WORD):
        out[i] = lcs(a[i], b[i])
    some = np.flatnonzero((na > 0) & (na <= WORD))
    for rows, x, y, ascii_only in _batches([a[i] for i in some], [b[i] for i in some], nb[some]):
        n, m = na[some][rows], nb[some][rows]
        width = -(-int(n.max()) // 8) * 8
        left, right = _narrow(_padded(x, n, width, 1), _padded(y, m, int(m.max()), 2), ascii_only)
        right = np.ascontiguousarray(right.T)
        v = np.full(len(x), ~np.uint64(0))
        word = np.zeros((len(x), 8), np.uint8)
        for c in right:
            word[:, : width // 8] = np.packbits(left == c[:, None], axis=1, bitorder="little")
            u = v & word.view("<u8")[:, 0]
            v = (v + u) | (v - u)
        free = np.bitwise_count(v & (~np.uint64(0) >> (WORD - n).astype(np.uint64)))
        out[some[rows]] = n - free
    return out


def ratio(a: list[str], b: list[str]) -> np.ndarray:
    total = _lengths(a) + _lengths(b)
    return np.where(total > 0, 200.0 * lcs_many(a, b) / np.maximum(total, 1), 100.0)


def _sorted(x: set[str] | list[str]) -> str:
    return " ".join(sorted(x))


def token_sort(a: list[str], b: list[str]) -> np.ndarray:
    return ratio([_sorted(x.split()) for x in a], [_sorted(x.split()) for x in b])


def token_set(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio among the shared tokens and the shared with either rest."""
    out = np.zeros(len(a))
    at, left, right = [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = set(s.split()), set(t.split())
        both = x & y
        if not x or not y:
            out[i] = 100.0 if s == t else 0.0
        elif both and (both == x or both == y):
            out[i] = 100.0
        else:
            shared = _sorted(both)
            one, two = (" ".join(filter(None, [shared, _sorted(r)])) for r in (x - y, y - x))
            compared = [(one, two), (shared, one), (shared, two)] if both else [(one, two)]
            at += [i] * len(compared)
            left += [c[0] for c in compared]
            right += [c[1] for c in compared]
    np.maximum.at(out, at, ratio(left, right))
    return out


def _bounded(s: str, t: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, bound) of the windows of ``t`` as long as ``s``, the best bound first: no subsequence is longer than the characters in common are many."""
    n = len(s)
    count = Counter(s)
    text = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.frombuffer("".join(count).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros((len(own), len(t) + 1), np.int32)
    np.cumsum(text == own[:, None], 1, out=seen[:, 1:])
    start = np.arange(1 - n, len(t))
    low, high = np.maximum(start, 0), np.minimum(start + n, len(t))
    common = np.minimum(seen[:, high] - seen[:, low], np.array([*count.values()])[:, None]).sum(0)
    bound = 200.0 * common / (n + high - low)
    order = np.argsort(-bound, kind="stable")
    return start[order], bound[order]


def _bounded_many(a: list[str], b: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``_bounded`` of pairs of which the first is the shorter and not empty: the windows of a batch slide together, a character comes and one goes."""
    out: list = [None] * len(a)
    by = _lengths(b)
    for rows, x, y, _ in _batches(a, b, by):
        n, m = _lengths(x), _lengths(y)
        codes, both = np.unique(np.concatenate([_padded(x, n, int(n.max()), 1).ravel(), _padded(y, m, int(m.max()), 2).ravel()]), return_inverse=True)
        if len(codes) > ALPHABET:
            for i, s, t in zip(rows, x, y, strict=True):
                out[i] = _bounded(s, t)
            continue
        s, t = both[: len(x) * n.max()].reshape(len(x), -1), both[len(x) * n.max() :].reshape(len(x), -1)
        every, width = np.arange(len(x)), len(codes)
        free = np.bincount((every[:, None] * width + s).ravel(), minlength=len(x) * width)  # of each character, how many the window lacks
        common, steps = np.zeros(len(x), np.int64), int((n + m).max()) - 1
        bound = np.full((len(x), steps), -np.inf)
        for w in range(steps):
            if w < t.shape[1]:
                at = (every * width + t[:, w])[w < m]
                common[w < m] += free[at] > 0
                free[at] -= 1
            k = np.flatnonzero((w >= n) & (w - n < m))
            at = k * width + t[k, w - n[k]]
            free[at] += 1
            common[k] -= free[at] > 0
            size = n + np.minimum(w + 1, m) - np.maximum(w + 1 - n, 0)
            np.divide(200.0 * common, size, out=bound[:, w], where=w < n + m - 1)
        order = np.argsort(-bound, axis=1, kind="stable")
        for j, i in enumerate(rows):
            o = order[j, : n[j] + m[j] - 1]
            out[i] = (o + 1 - n[j], bound[j, o])
    return out


def partial(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter string with any window of the longer, windows at the ends being shorter too.

    Windows are compared in rounds, the most promising first; those whose bound is no better than what a pair has are never made.
    """
    out = np.zeros(len(a))
    open_: list[tuple] = []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        s, t = (s, t) if len(s) <= len(t) else (t, s)
        if not s:
            out[i] = 0.0 if t else 100.0
        elif s in t:
            out[i] = 100.0
        else:
            open_.append((i, s, t))
    open_ = [(*x, *w) for x, w in zip(open_, _bounded_many([x[1] for x in open_], [x[2] for x in open_]), strict=True)]
    at, step = 0, 1
    while open_:
        pairs, left, right = [], [], []
        for i, s, t, start, bound in open_:
            for k, most in zip(start[at : at + step].tolist(), bound[at : at + step].tolist(), strict=True):
                if most <= out[i]:
                    break
                pairs.append(i)
                left.append(s)
                right.append(t[max(k, 0) : k + len(s)])
        if pairs:
            np.maximum.at(out, pairs, ratio(left, right))
        at, step = at + step, min(2 * step, 16)
        open_ = [x for x in open_ if at < len(x[3]) and x[4][at] > out[x[0]]]
    return out


def partial_token_set(a: list[str], b: list[str]) -> np.ndarray:
    sets = [(set(s.split()), set(t.split())) for s, t in zip(a, b, strict=True)]
    out = np.full(len(a), 100.0)
    apart = [i for i, (x, y) in enumerate(sets) if not x & y]
    if apart:
        out[apart] = partial([_sorted(sets[i][0]) for i in apart], [_sorted(sets[i][1]) for i in apart])
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    na, nb = _lengths(a), _lengths(b)
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    some = np.flatnonzero((out == 0) & (na > 0) & (nb > 0))
    for rows, x, y, ascii_only in _batches([a[i] for i in some], [b[i] for i in some], nb[some]):
        n, m = na[some][rows], nb[some][rows]
        left, right = _narrow(_padded(x, n, int(n.max()), 1), _padded(y, m, int(m.max()), 2), ascii_only)
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        place = np.arange(right.shape[1])
        used, first = np.zeros(right.shape, bool), np.zeros(left.shape, bool)
        for i in range(left.shape[1]):
            here = (right == left[:, i : i + 1]) & ~used & (place >= (i - reach)[:, None]) & (place <= (i + reach)[:, None])
            to = here.argmax(1)
            hit = here[np.arange(len(x)), to]
            used[np.flatnonzero(hit), to[hit]] = True
            first[:, i] = hit
        k = first.sum(1)
        moved = np.bincount(np.repeat(np.arange(len(x)), k), weights=left[first] != right[used], minlength=len(x)) // 2
        some_k = np.maximum(k, 1)
        jaro = np.where(k > 0, (k / n + k / m + (k - moved) / some_k) / 3, 0.0)
        head = min(4, left.shape[1], right.shape[1])
        prefix = np.cumprod(left[:, :head] == right[:, :head], axis=1).sum(1)
        out[some[rows]] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


KERNELS: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {
    "ratio": ratio, "tsort": token_sort, "tset": token_set, "partial": partial, "ptset": partial_token_set, "jw": jaro_winkler
}


def kernels(a: Column, b: Column, *names: str) -> Column:
    """struct of the named kernels as doubles. A null string counts as empty."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        left, right = x.fillna("").tolist(), y.fillna("").tolist()
        return pd.DataFrame({n: KERNELS[n](left, right) for n in names}, columns=list(names))

    return run(a, b)
