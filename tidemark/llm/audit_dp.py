"""Cheapest repairs of a turn sequence as a persistent audit: the small helper behind ``turn_repair``.

Turns are read as codes: the role's initial (``.`` for a role that cannot stay)
and a fault (``-`` none, ``t`` truncated, ``x`` must go). A sequence is legal if
its initials have the form ``(s?(ua)+)?``. For each state of that form the best
edits so far are one linked node; nodes share their prefixes, know ancestors at
powers of two and hold a rolling hash of the letters from the root. Two audits of
equal cost are compared at their first difference, found by jumping up while the
hashes differ; what the hashes call equal is checked letter by letter up to the
node that both share, and a collision falls back to the letters.

Keeping only the least audit of a state is exact: an audit string fixes its
states and its cost, and audits of one stage hold as many letters of K, R and D
each, so none is a proper prefix of another of the same cost.
"""

from __future__ import annotations

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MODULUS, BASE = (1 << 61) - 1, 1_000_003
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, S, U, A = range(4)
STATES = (START, S, U, A)
#: The state that a turn of a user or an assistant leads to, by the state before: the one that may come next.
NEXT = (U, U, A, U)
KEPT = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
ROLES = {U: "user", A: "assistant"}


class Node:
    """The end of an audit; ``piece`` is its last letter, or the letters of a segment."""

    __slots__ = ("depth", "hash", "piece", "up")

    def __init__(self, piece: str = "", parent: Node | None = None):
        self.piece = piece
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        value = 0
        for x in piece:
            value = (value * 257 + ord(x) + 1) % MODULUS
        self.hash = (parent.hash * BASE + value + 1) % MODULUS
        up, at, k = [parent], parent, 0
        while len(at.up) > k:
            at = at.up[k]
            up.append(at)
            k += 1
        self.up = tuple(up)

    def above(self, depth: int) -> Node:
        at, k, rest = self, 0, self.depth - depth
        while rest:
            if rest & 1:
                at = at.up[k]
            rest >>= 1
            k += 1
        return at

    def pieces(self) -> list[str]:
        out, at = [], self
        while at.depth:
            out.append(at.piece)
            at = at.up[0]
        return out[::-1]

    def text(self) -> str:
        return "".join(self.pieces())


def same(x: Node, y: Node) -> bool:
    """Whether two nodes of one depth really spell the same, up to the node they share."""
    while x is not y:
        if x.piece != y.piece:
            return False
        x, y = x.up[0], y.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` comes before that of ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = a.above(depth), b.above(depth)
    if x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else a.text() < b.text()
    k = len(x.up) - 1
    while k >= 0:  # to the highest pair whose hashes differ
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
        k -= 1
    if x.piece == y.piece or not same(x.up[0], y.up[0]):
        return a.text() < b.text()
    return x.piece < y.piece


def _offer(best: list, state: int, cost: int, parent: Node, letter: str) -> None:
    old = best[state]
    if old is None or cost < old[0]:
        best[state] = cost, Node(letter, parent)
    elif cost == old[0]:
        node = Node(letter, parent)
        if less(node, old[1]):
            best[state] = cost, node


def inserted(best: list) -> list:
    """With insertions: cheaper states first, so that each is final when it is left."""
    best, left = list(best), {s for s in STATES if best[s] is not None}
    done: set[int] = set()
    while left:
        s = min(left, key=lambda s: (best[s][0], s))
        left.discard(s)
        done.add(s)
        to = NEXT[s]
        if to not in done:
            _offer(best, to, best[s][0] + INSERT, best[s][1], "I")
            left.add(to)
    return best


def edited(best: list, initial: str, fault: str) -> list:
    """After one more turn."""
    new: list = [None] * 4
    more = TRUNCATED if fault == "t" else 0
    for s, entry in enumerate(best):
        if entry is None:
            continue
        cost, node = entry
        _offer(new, s, cost + DELETE, node, "D")
        if fault == "x":
            continue
        to = KEPT.get((initial, s))
        if to is not None:
            _offer(new, to, cost + KEEP + more, node, "K")
        _offer(new, NEXT[s], cost + REROLE + more, node, "R")
    return new


def segment(codes: str, start: int) -> list:
    """Best (cost, audit) for each end state of some turns that begin in ``start``; two letters of code a turn."""
    best: list = [None] * 4
    best[start] = 0, Node()
    for k in range(0, len(codes), 2):
        best = edited(inserted(best), codes[k], codes[k + 1])
    return [None if e is None else (e[0], e[1].text()) for e in best]


class Fold:
    """Segments of one conversation, in order, put together."""

    def __init__(self):
        self.best: list = [None] * 4
        self.best[START] = 0, Node()

    def add(self, tables: dict[int, list]) -> None:
        """``tables`` holds, for each state at its start, the best (cost, audit) for each state at its end."""
        new: list = [None] * 4
        for s, entry in enumerate(self.best):
            if entry is None:
                continue
            for to, found in enumerate(tables[s]):
                if found is not None:
                    _offer(new, to, entry[0] + found[0], entry[1], found[1])
        self.best = new

    def result(self) -> tuple[int, str]:
        best = inserted(self.best)
        cost, node = best[START] or best[A]
        for s in (START, A):
            if best[s] is not None and (best[s][0] < cost or (best[s][0] == cost and less(best[s][1], node))):
                cost, node = best[s]
        return cost, node.text()

