"""Regexes over bytes as one minimal deterministic automaton.

Patterns know literals, classes, groups, ``|``, ``? * +``, ``{m}``, ``{m,}`` and ``{m,n}``, ``\\xNN`` and
escaped punctuation. They become an epsilon-free set machine by subset construction; partition refinement
then merges equal states, and the result is a flat transition array: next = T[state + byte], with states
numbered in steps of 256 and accepting states last.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1


class _Parser:
    """Builds (start, end) fragments; ``back`` builds the machine of the reversed language."""

    def __init__(self, nfa: _Nfa, pattern: str, fold: bool, back: bool):
        self.n, self.p, self.i, self.fold, self.back = nfa, pattern, 0, fold, back

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def either(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.n.state(), self.n.state()
        for x, y in parts:
            self.n.eps[a].append(x)
            self.n.eps[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return self.chain(parts)

    def chain(self, parts: list[tuple[int, int]]) -> tuple[int, int]:
        if not parts:
            a = self.n.state()
            return a, a
        if self.back:
            parts = parts[::-1]
        for (_, y), (x, _) in zip(parts, parts[1:], strict=False):
            self.n.eps[y].append(x)
        return parts[0][0], parts[-1][1]

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        part = self.atom()
        end = self.i
        c = self.peek()
        if c in ("?", "*", "+") and c:
            self.i += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif c == "{":
            to = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : to].partition(",")
            least, most = int(low), (int(high) if high else None) if "," in self.p[self.i : to] else int(low)
            self.i = to + 1
        else:
            return part
        after = self.i

        def copy() -> tuple[int, int]:
            self.i = begin
            x = self.atom()
            assert self.i == end
            self.i = after
            return x

        parts = [part if k == 0 else copy() for k in range(max(least, 1 if most is None else most))]
        if most is None:
            x, y = copy()
            a, b = self.n.state(), self.n.state()
            self.n.eps[a] += [x, b]
            self.n.eps[y] += [x, b]
            parts = parts[:least] + [(a, b)]
        else:
            for k in range(least, most):
                x, y = parts[k]
                a, b = self.n.state(), self.n.state()
                self.n.eps[a] += [x, b]
                self.n.eps[y].append(b)
                parts[k] = (a, b)
        return self.chain(parts)

    def code(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.i += 1
            x = self.either()
            self.i += 1
            return x
        if c == "[":
            self.i += 1
            out = self.peek() == "^"
            self.i += out
            found: set[int] = set()
            while self.peek() != "]":
                a = self.code()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    found |= {*range(a, self.code() + 1)}
                else:
                    found.add(a)
            self.i += 1
            if out:
                found = {*range(256)} - found
        elif c == ".":
            self.i += 1
            found = {*range(256)} - {10}
        else:
            found = {self.code()}
        if self.fold:
            found |= {x ^ 32 for x in found if 65 <= (x & ~32) <= 90}
        a, b = self.n.state(), self.n.state()
        self.n.move[a] = (frozenset(found), b)
        return a, b


@dataclass
class Dfa:
    table: list[int]
    start: int
    first_accepting: int
    #: rules accepted, by state / 256
    accepts: list[tuple[int, ...]] = field(default_factory=list)
    #: the state without a way out, or -1
    dead: int = -1


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool, back: bool = False) -> Dfa:
    """One automaton for all (pattern, either case). Unless ``anchored``, a match may begin at any byte."""
    nfa, starts, ends = _Nfa(), [], {}
    for k, (p, fold) in enumerate(patterns):
        a, b = _Parser(nfa, p, fold, back).either()
        starts.append(a)
        ends[b] = k

    def closure(states) -> frozenset:
        todo, seen = [*states], set(states)
        while todo:
            for x in nfa.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    # bytes that no class tells apart share a column
    sets = {m[0] for m in nfa.move if m}
    groups: dict[tuple, list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    columns = [*groups.values()]
    first = closure(starts)
    found, order, rows = {first: 0}, [first], []
    for s in order:
        row = []
        for c in columns:
            moved = {nfa.move[x][1] for x in s if nfa.move[x] and c[0] in nfa.move[x][0]}
            t = closure(moved if anchored else moved | set(starts))
            if t not in found:
                found[t] = len(order)
                order.append(t)
            row.append(found[t])
        rows.append(row)
    marks = [tuple(sorted({ends[x] for x in s if x in ends})) for s in order]
    # minimisation: refine by what is accepted, then by the classes that each byte leads to
    block = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    of = [block[m] for m in marks]
    while True:
        keys = [(of[i], *(of[t] for t in rows[i])) for i in range(len(order))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        new = [names[k] for k in keys]
        if len(names) == len(set(of)):
            break
        of = new
    one = {b: i for i, b in reversed([*enumerate(of)])}
    ranked = sorted(one, key=lambda b: (bool(marks[one[b]]), b))
    at = {b: 256 * i for i, b in enumerate(ranked)}
    table = [0] * (256 * len(ranked))
    for b in ranked:
        for c, t in zip(columns, rows[one[b]], strict=True):
            for x in c:
                table[at[b] + x] = at[of[t]]
    accepts = [marks[one[b]] for b in ranked]
    dead = next((at[b] for b in ranked if not marks[one[b]] and all(of[t] == b for t in rows[one[b]])), -1) if anchored else -1
    return Dfa(table, at[of[0]], 256 * next((i for i, m in enumerate(accepts) if m), len(accepts)), accepts, dead)


class Scanner:
    """Leftmost, longest, non-overlapping matches of each rule, all rules in one pass over the bytes.

    The pass runs the joint automaton, which tells where a match of a rule first ends. An anchored
    automaton read backwards then finds the leftmost start after the rule's last match, and one read
    forwards the longest end.
    """

    def __init__(self, patterns: list[tuple[str, bool]]):
        self.joint = compile_rules(patterns, anchored=False)
        self.forward = [compile_rules([p], anchored=True) for p in patterns]
        self.backward = [compile_rules([p], anchored=True, back=True) for p in patterns]

    @staticmethod
    def _reach(dfa: Dfa, data: bytes, positions: range) -> int:
        """How many bytes the longest accepted run takes, or -1."""
        s, n, best, table = dfa.start, 0, -1, dfa.table
        for i in positions:
            s = table[s + data[i]]
            n += 1
            if s >= dfa.first_accepting:
                best = n
            elif s == dfa.dead:
                break
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by end of discovery."""
        table, accepting, accepts = self.joint.table, self.joint.first_accepting, self.joint.accepts
        s, out, done = self.joint.start, [], [0] * len(self.forward)
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= accepting:
                for rule in accepts[s >> 8]:
                    if i >= done[rule]:
                        n = self._reach(self.backward[rule], data, range(i, done[rule] - 1, -1))
                        if n > 0:
                            start = i + 1 - n
                            end = start + self._reach(self.forward[rule], data, range(start, len(data)))
                            out.append((rule, start, end))
                            done[rule] = end
        return out
