"""A context-mixing range coder for token ids, run over many blocks at once.

Every block has a model of its own and stands alone. Blocks are the lanes of numpy arrays: one step codes the next
id of each block, so the cost of Python is shared by thousands of blocks. What a reader computes is in integers,
hence equal on every machine.

The model of a block, for its next id:

* order 2 and order 1 each predict one id, the one that followed this context last, and trust it by how often in a row it did; the more trusted one is predicted;
* order 0 holds the frequencies of the block's frequent ids among those that were not predicted;
* a mixer adds what the three orders say of the predicted id in the logistic domain, by weights that are learnt from the block;
* if the id is another one, it is coded by its order-0 frequency, and an id without one by its 16 or 32 bits.

Orders 1 and 2 adapt from nothing. The weights and the order-0 table are learnt from the whole block before it is
coded and lead its payload, so that predictions, trusts and cells of the mixer are made for all places of a block
at once, and only the range coder goes id by id. A payload (numbers are little-endian):

| bytes | field |
|-|-|
| 4 | weights of order 2, 1, 0 and of the constant, in 1/32, signed |
| 2, 1 | ids that are neither predicted nor in the table; k, the ids of the table |
| k or 3 k | last 8 (of 32: 24) bits of the table's ids, in ascending order |
| (k + 1) // 2 | levels of their frequencies, 4 bits each |
| (k + 263) // 8, none if k is 0 | for each value of the first 8 bits, a one for each id, then a zero |
| 2 each | words of the range coder |
"""

from __future__ import annotations

import struct
from decimal import Decimal
from functools import lru_cache

import numpy as np

#: Ids of a block, and blocks that are coded together, at most.
BLOCK = 2048
LANES = 4096
#: Blocks whose models are learnt together.
LEARNT = 32
#: Contexts of orders 1 and 2 are told apart by so many bits.
CONTEXT_BITS = 8
#: Symbols of order 0: places for frequent ids, the last one for all other ids. Frequencies are parts of 2**SCALE.
PLACES = 256
OTHER = PLACES - 1
SCALE = 11
#: Counts of an id of order 0, by level; an id that is left over once is not in the table.
LEVELS = np.array([2, 3, 4, 5, 6, 8, 11, 15, 21, 30, 45, 70, 120, 220, 420, 800])
#: What the orders say of the predicted id, as logits in 1/256: by trust of an order that predicts it, of one that predicts another id; by order 0's level.
SAYS_2, AGAINST_2 = [-610, -440, 60, 840], [-610, -470, -520, -520]
SAYS_1, AGAINST_1 = [-580, 0, 300, 800], [-580, -390, -340, -920]
SAYS_0 = [-130, -180, -210, -235, -235, -165, -65, 80]
#: Cells of the mixer: trust of order 2 << 6 | level of order 0 << 3 | order 1 agrees << 2 | trust of order 1.
CELLS = 256
A = np.uint32(0x9E3779B1)
I, U, F = np.int64, np.uint64, np.float32
#: An interval is that long at least and 2**16 times that at most.
LEAST_RANGE = U(1 << 32)
HEAD = struct.Struct("<4bHB")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """What the three orders and the constant say in each cell, and the probability (1/65536) of a logit from -8 to 8 in 1/256.

    The exponentials come from ``decimal``, so that every machine computes the same.
    """
    cell = np.arange(CELLS)
    n2, level, agree, n1 = cell >> 6, cell >> 3 & 7, cell >> 2 & 1, cell & 3
    two = np.where((agree == 1) | (n2 >= n1), np.array(SAYS_2)[n2], np.array(AGAINST_2)[n2])
    one = np.where((agree == 1) | (n2 < n1), np.array(SAYS_1)[n1], np.array(AGAINST_1)[n1])
    squash = [int(65536 / (1 + (Decimal(-x) / 256).exp())) for x in range(-2048, 2048)]
    return np.array([two, one, np.array(SAYS_0)[level], np.full(CELLS, 256)]), np.clip(np.array(squash, I), 64, 65536 - 64)


def chances(weights: np.ndarray) -> np.ndarray:
    """The probability (1/65536) that the predicted id comes, by lane and cell; 0 where none is predicted."""
    says, squash = tables()
    logit = sum(weights[:, k, None].astype(I) * says[k] for k in range(4)) >> 5
    p = squash[np.clip(logit, -2048, 2047) + 2048].astype(np.uint32)
    p[:, (np.arange(CELLS) & (3 << 6 | 3)) == 0] = 0
    return p


def learnt_weights(seen: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Weights in 1/32 by lane, from the number of predictions and of right ones by lane and cell: steps of Newton's method, as long as they gain."""
    z, seen, hits = (tables()[0].T / 256).astype(F), seen.astype(F), hits.astype(F)
    pairs = (z[:, :, None] * z[:, None, :]).reshape(CELLS, 16)
    first = np.array([1, 1, 1, 0], F)
    best, least = np.tile(first, (len(seen), 1)), np.full(len(seen), np.inf, F)
    w = best
    for step in range(2):
        # lane by lane, so that a lane's sums do not depend on the others
        logit = np.clip((w[:, None, :] @ z.T)[:, 0], -7.9, 7.9)
        loss = (seen * np.log1p(np.exp(logit)) - hits * logit).sum(-1) + ((w - first) ** 2).sum(-1)
        gain = loss < least
        best, least = np.where(gain[:, None], w, best), np.where(gain, loss, least)
        if step == 1:
            break
        p = 1 / (1 + np.exp(-logit))
        slope = ((hits - seen * p)[:, None, :] @ z)[:, 0] - 2 * (w - first)
        curve = ((seen * p * (1 - p))[:, None, :] @ pairs).reshape(-1, 4, 4) + 2 * np.eye(4, dtype=F)
        w = np.clip(w + np.linalg.solve(curve, slope[..., None])[..., 0], -3.9, 3.9)
    return np.rint(best * 32).astype(np.int8)


def frequencies(level: np.ndarray, lane: np.ndarray, place: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, 2**SCALE in all, and their sums before each place, by lane and place; ``other``: ids beside the table by lane."""
    freq = np.zeros((len(other), PLACES), I)
    freq[lane, place] = LEVELS[level]
    freq = (freq << SCALE) // (freq.sum(1) + np.maximum(other, 1))[:, None]
    freq[:, OTHER] = (1 << SCALE) - freq.sum(1)
    return freq, np.cumsum(freq, 1) - freq


def grade(level: np.ndarray) -> np.ndarray:
    """Levels of table ids as the mixer sees them, 1 to 7 (0: not in the table)."""
    return 1 + np.minimum(level >> 1, 6)


def sorted_places(values: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By lane, in the order of values and then of places: the place among all lanes, the value, whether the one before it is equal."""
    lanes, n = values.shape
    bits = kind((n - 1).bit_length())
    key = np.sort(values.astype(kind, copy=False) << bits | np.arange(n, dtype=kind), 1)
    at = (key & ((kind(1) << bits) - kind(1))).astype(I)
    at += (np.arange(lanes) * n)[:, None]
    key >>= bits
    known = np.zeros(values.shape, bool)
    np.equal(key[:, 1:], key[:, :-1], out=known[:, 1:])
    return at, key, known


def predictions(ids: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By lane and place: the place among all lanes of the id that followed the same context last, and the trust in it (0: there was none)."""
    at, _, known = sorted_places(context, np.uint32)
    found = ids.take(at)
    right = known.copy()
    right[:, 1:] &= found[:, 1:] == found[:, :-1]
    once = known[:, 1:] & right[:, :-1]
    trust = known.astype(np.uint8)
    trust[:, 1:] += once
    trust[:, 2:] += once[:, 1:] & right[:, :-2]
    both = trust.astype(I)
    both[:, 1:] += at[:, :-1] * 4
    out = np.empty(ids.size, I)
    out[at.ravel()] = both.ravel()
    out = out.reshape(ids.shape)
    return out >> 2, (out & 3).astype(np.uint32)


def order_0(ids: np.ndarray, left: np.ndarray, wide: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The tables of ids that are ``left`` twice or more, as (lane, id, symbol, level), and symbol | grade << 8 by lane and place."""
    lanes, n = ids.shape
    kind = U if wide or n > 1 << 16 else np.uint32
    at, key, known = sorted_places(ids, kind)
    new = ~known
    first = np.flatnonzero(new)
    count = np.add.reduceat(left.ravel().take(at.ravel()).astype(np.int32), first)
    keep = np.flatnonzero(count > 1)
    lane = first[keep] // n
    if np.bincount(lane).max(initial=0) > OTHER:
        best = np.lexsort((-count[keep], lane))  # equal counts stay in the order of ids
        rank = np.arange(len(best)) - np.searchsorted(lane, lane)
        keep = np.sort(keep[best[rank < OTHER]])
        lane = first[keep] // n
    symbol = np.arange(len(keep)) - np.searchsorted(lane, lane)
    level = np.searchsorted(LEVELS, count[keep], "right") - 1
    seen = np.full(len(first), OTHER, np.uint16)
    seen[keep] = symbol | grade(level) << 8
    out = np.empty(ids.size, np.uint16)
    out[at.ravel()] = np.repeat(seen, np.diff(first, append=ids.size))
    return (lane, key.ravel()[first[keep]].astype(np.uint32), symbol, level), out.reshape(ids.shape)


def heads(weights: np.ndarray, other: np.ndarray, table: tuple[np.ndarray, ...], wide: bool) -> list[bytes]:
    lane, own, _, level = table
    begin = np.searchsorted(lane, np.arange(len(other) + 1))
    parts = own.astype("<u4").view(np.uint8).reshape(-1, 4)
    low, high = np.ascontiguousarray(parts[:, : 3 if wide else 1]), parts[:, 3 if wide else 1].astype(I)
    out = []
    for j, (w, n) in enumerate(zip(weights.tolist(), other.tolist(), strict=True)):
        a, b = begin[j], begin[j + 1]
        k = int(b - a)
        head = HEAD.pack(*w, n, k)
        if k:
            levels, ones = np.zeros(k + k % 2, np.uint8), np.zeros(k + 256, np.uint8)
            levels[:k] = level[a:b]
            ones[high[a:b] + np.arange(k)] = 1
            head += low[a:b].tobytes() + (levels[::2] | levels[1::2] << 4).tobytes() + np.packbits(ones).tobytes()
        out.append(head)
    return out


def opened(payloads: list[bytes], wide: bool) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], list[bytes]]:
    """Weights, ids beside the table, tables and words, the inverse of ``heads``."""
    step = 3 if wide else 1
    weights, other, counts, own, levels, rest = [], [], [], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)], []
    for p in payloads:
        *w, n, k = HEAD.unpack_from(p)
        at = HEAD.size
        if k:
            low = np.zeros((k, 4), np.uint8)
            low[:, :step] = np.frombuffer(p, np.uint8, k * step, at).reshape(k, step)
            at += k * step
            two = np.frombuffer(p, np.uint8, (k + 1) // 2, at)
            at += (k + 1) // 2
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8, (k + 263) // 8, at), count=k + 256))
            at += (k + 263) // 8
            low[:, step] = ones - np.arange(k)
            own.append(low.view("<u4").ravel())
            levels.append(np.stack([two & 15, two >> 4], 1).ravel()[:k])
        weights.append(w)
        other.append(n)
        counts.append(k)
        rest.append(p[at:])
    lane = np.repeat(np.arange(len(payloads)), counts)
    symbol = np.arange(len(lane)) - np.searchsorted(lane, lane)
    return np.array(weights, np.int8), np.array(other), (lane, np.concatenate(own), symbol, np.concatenate(levels).astype(I)), rest


def learn(ids: np.ndarray, size: np.ndarray, wide: bool) -> tuple[list[bytes], tuple[np.ndarray, ...]]:
    """The heads of some lanes, and by lane and place: chance of the prediction, whether it is right, start and size of the symbol."""
    lanes, n = ids.shape
    b1, b2 = np.zeros_like(ids), np.zeros_like(ids)
    b1[:, 1:], b2[:, 2:] = ids[:, :-1], ids[:, :-2]
    mask = np.uint32((1 << CONTEXT_BITS) - 1)
    s2, n2 = predictions(ids, (b1 * A + b2) & mask)
    s1, n1 = predictions(ids, b1 & mask)
    source, some = np.where(n2 >= n1, s2, s1), (n1 | n2) > 0
    guess, valid = ids.take(source), np.arange(n) < size[:, None]
    hit = (guess == ids) & some
    left = valid & ~hit
    table, seen = order_0(ids, left, wide)
    lane, _, symbol, level = table
    bare = left & (seen & 255 == OTHER)
    other = bare.sum(1)
    cell = (n2 << 6 | (seen.take(source) >> 8) << 3 | (ids.take(s1) == ids.take(s2)) << 2 | n1).astype(I)
    cell += (np.arange(lanes) * CELLS)[:, None]
    told = valid & some
    tally = [np.bincount(cell[x], minlength=lanes * CELLS).reshape(lanes, CELLS) for x in (told, told & hit)]
    weights = learnt_weights(*tally)
    freq, start = frequencies(level, lane, symbol, other)
    p = chances(weights).astype(np.uint16).ravel().take(cell)
    place = (seen & 255) + (np.arange(lanes) * PLACES)[:, None]
    return heads(weights, other, table, wide), (p, hit, start.astype(np.uint16).ravel().take(place), freq.astype(np.uint16).ravel().take(place), bare)


class Writer:
    """Range coders of ``n`` blocks. An interval is ``range`` long and begins at ``low``, of which 48 bits and a carry are not written yet."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, U), np.full(n, (1 << 48) - 1, U)
        self.to, self.words = [], []

    def shift(self, at: np.ndarray) -> None:
        low = self.low.take(at)
        self.to.append(at.astype(np.uint16))
        self.words.append((low >> U(32)).astype(np.uint32))
        self.low[at] = (low & U(0xFFFFFFFF)) << U(16)
        self.range[at] <<= U(16)

    def settle(self, m: int) -> None:
        at = np.flatnonzero(self.range[:m] < LEAST_RANGE)
        while len(at):
            self.shift(at)
            at = at[self.range.take(at) < LEAST_RANGE]

    def finish(self) -> list[bytes]:
        """The words of each block: of the interval's numbers the one with most zeros at the end."""
        n = len(self.low)
        self.to.append(np.arange(n, dtype=np.uint16))
        self.words.append(((self.low + U(0xFFFFFFFF)) >> U(32)).astype(np.uint32))
        to, words = np.concatenate(self.to), np.concatenate(self.words)
        by = np.argsort(to, kind="stable")
        words, first = words[by], np.searchsorted(to[by], np.arange(n + 1))
        while (carry := words >> np.uint32(16)).any():  # never beyond a block's first word, since the whole number is below 1
            words &= np.uint32(0xFFFF)
            words[:-1] += carry[1:]
        words, first = words.astype("<u2").tobytes(), (2 * first).tolist()
        return [words[a:b] for a, b in zip(first, first[1:], strict=False)]


def arranged(sizes: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Blocks in the order of falling size, these sizes, and how many blocks have an id at each place."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order])
    return order, size, np.searchsorted(-size, -np.arange(size[0]), "left")


def encode(blocks: list[np.ndarray], wide: bool) -> list[bytes]:
    """The payload of every block of ids (at most ``LANES``, none empty). Ids are below 2**16, or below 2**32 if ``wide``."""
    order, size, active = arranged([len(b) for b in blocks])
    shape = (int(size[0]), len(blocks))
    chance, start, part = (np.zeros(shape, np.uint16) for _ in range(3))
    hit, lead, bare = np.zeros(shape, bool), [], []
    for a in range(0, len(blocks), LEARNT):
        own = np.zeros((min(LEARNT, len(blocks) - a), int(size[a])), np.uint32)
        for j in range(len(own)):
            own[j, : size[a + j]] = blocks[order[a + j]]
        head, found = learn(own, size[a : a + len(own)], wide)
        lead += head
        for to, x in zip((chance, hit, start, part), found[:4], strict=True):
            to[: own.shape[1], a : a + len(own)] = x.T
        row, place = np.nonzero(found[4])
        bare.append((place.astype(np.uint16), (row + a).astype(np.uint16), own[row, place]))
    w = Writer(len(blocks))
    place, lane, value = (np.concatenate(x) for x in zip(*bare, strict=True))
    by = np.argsort(place, kind="stable")
    n_bare, lane, value = np.searchsorted(place[by], np.arange(shape[0] + 1)), lane[by].astype(I), value[by].astype(U)
    for t in range(shape[0]):
        if not t % 32:
            chances_, starts, parts = (x[t : t + 32].astype(U) for x in (chance, start, part))
        m = active[t]
        span, right = w.range[:m], hit[t, :m]
        own = (span >> U(16)) * chances_[t % 32, :m]
        rest = (span - own) >> U(SCALE)
        w.low[:m] += np.where(right, U(0), own + rest * starts[t % 32, :m])
        w.range[:m] = np.where(right, own, rest * parts[t % 32, :m])
        w.settle(m)
        if n_bare[t] < n_bare[t + 1]:
            at, bits = lane[n_bare[t] : n_bare[t + 1]], value[n_bare[t] : n_bare[t + 1]]
            for half in range(2 if wide else 1):
                r = w.range.take(at) >> U(16)
                w.low[at] += r * (bits >> U(16 * half) & U(0xFFFF))
                w.range[at] = r
                w.shift(at)
    del chance, start, part, hit, lane, value
    out = [b""] * len(blocks)
    for i, head, words in zip(order, lead, w.finish(), strict=True):
        out[i] = head + words
    return out


class Reader:
    """Models and range decoders of blocks, the longest first. ``code`` is where in the interval the written number lies."""

    def __init__(self, payloads: list[bytes], wide: bool):
        weights, other, (lane, own, symbol, level), words = opened(payloads, wide)
        n, self.wide = len(payloads), wide
        self.kind = U if wide else np.uint32
        self.chance = chances(weights).astype(U).ravel()
        freq, start = frequencies(level, lane, symbol, other)
        self.slot = np.repeat(np.tile(np.arange(PLACES, dtype=np.uint8), n), freq.ravel())
        entry = np.zeros((n, PLACES), U)  # id << 6 | grade << 3
        entry[lane, symbol] = own.astype(U) << U(6) | (grade(level) << 3).astype(U)
        self.symbol = (entry << U(24) | (start << 12 | freq).astype(U)).ravel()
        self.guess = [np.zeros(n << CONTEXT_BITS, self.kind) for _ in range(2)]  # by context: an entry | trust; 0: none
        self.contexts, self.cells = np.arange(n) << CONTEXT_BITS, np.arange(n) * CELLS
        self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        # three words are read ahead, two of them beyond the last
        self.data = np.frombuffer(b"".join(w + bytes(4) for w in words), "<u2")
        size = np.array([len(w) // 2 + 2 for w in words])
        self.next = np.cumsum(size) - size
        self.range, self.code = np.full(n, (1 << 48) - 1, U), np.zeros(n, U)
        for _ in range(3):
            self.code = self.code << U(16) | self.data.take(self.next, mode="clip")
            self.next += 1

    def shift(self, at: np.ndarray) -> None:
        place = self.next.take(at, mode="clip")
        self.code[at] = self.code.take(at, mode="clip") * U(1 << 16) + self.data.take(place, mode="clip")
        self.range[at] = self.range.take(at, mode="clip") * U(1 << 16)
        self.next[at] = place + 1

    def step(self, m: int) -> np.ndarray:
        """The next ids of the first ``m`` lanes. Indexes are cut at the ends of the tables, where only a damaged payload leads."""
        k, (b1, b2) = self.kind, (b[:m] for b in self.before)
        span, code, after = self.range[:m], self.code[:m], self.next[:m]
        mask = np.uint32((1 << CONTEXT_BITS) - 1)
        c1, c2 = self.contexts[:m] + (b1 & mask), self.contexts[:m] + (b1 * A + b2 & mask)
        e2, e1 = self.guess[0].take(c2, mode="clip"), self.guess[1].take(c1, mode="clip")
        n2, n1 = e2 & k(3), e1 & k(3)
        guess = np.where(n2 >= n1, e2, e1)
        cell = n2 * k(64) + (guess & k(56)) + n1 + ((e1 ^ e2) < k(8)) * k(4)
        own = (span >> U(16)) * self.chance.take(self.cells[:m] + cell.astype(I), mode="clip")
        miss = np.flatnonzero(code >= own)
        inside, rest = (code - own).take(miss, mode="clip"), ((span - own) >> U(SCALE)).take(miss, mode="clip")
        slot = (inside // rest).view(I) + miss * (1 << SCALE)
        symbol = self.slot.take(slot, mode="clip")
        place = symbol + miss * PLACES
        found = self.symbol.take(place, mode="clip")
        code[miss] = inside - (found >> U(12) & U(0xFFF)) * rest
        span[:] = own
        span[miss] = (found & U(0xFFF)) * rest
        entry = guess & ~k(7)
        entry[miss] = (found >> U(24)).astype(k)
        # one word for those that need it, more for few
        short = (span < LEAST_RANGE).astype(U)
        scale = short * U(0xFFFF) + U(1)
        span *= scale
        code *= scale
        code += self.data.take(after, mode="clip") * short
        after += short.view(I)
        at = np.flatnonzero(span < LEAST_RANGE)
        while len(at):
            self.shift(at)
            at = at[span.take(at) < LEAST_RANGE]
        bare = miss[symbol == OTHER]
        if len(bare):
            value = np.zeros(len(bare), U)
            for half in range(2 if self.wide else 1):
                r = span.take(bare, mode="clip") >> U(16)
                now = code.take(bare, mode="clip")
                v = now // r
                code[bare] = now - v * r
                span[bare] = r
                self.shift(bare)
                value |= v << U(16 * half)
            entry[bare] = (value << U(6)).astype(k)
        # what was seen
        fresh, most = entry + k(1), entry + k(3)
        for c, e, to in ((c2, e2, self.guess[0]), (c1, e1, self.guess[1])):
            to[c] = np.where((e ^ entry) < k(8), np.minimum(e + k(1), most), fresh)
        out = (entry >> k(6)).astype(np.uint32, copy=False)
        b2[:] = b1
        b1[:] = out
        return out


def decode(payloads: list[bytes], sizes: list[int], wide: bool) -> list[np.ndarray]:
    """The ids of every block. What a damaged payload gives is undefined; callers compare checksums."""
    order, size, active = arranged(sizes)
    r = Reader([payloads[i] for i in order], wide)
    ids, some = np.zeros((len(order), int(size[0])), np.uint32), np.zeros((32, len(order)), np.uint32)
    for t, m in enumerate(active.tolist()):
        some[t % 32, :m] = r.step(m)
        if t % 32 == 31 or t == size[0] - 1:
            ids[:, t - t % 32 : t + 1] = some[: t % 32 + 1].T
    out: list[np.ndarray] = [ids[0]] * len(order)
    for j, i in enumerate(order):
        out[i] = ids[j, : size[j]]
    return out
