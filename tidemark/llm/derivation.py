"""Lightest derivations of a repaired conversation, found with an agenda.

An item says: the first i rows are done and the roles put out so far are in state q. States: E nothing yet, S a system
turn, U a user's turn last, A an assistant's turn last; a conversation may end in E or A. A deduction leads from an item to the next by
one edit, and its weight (cost, audit) is the antecedent's with the edit's cost added and its letter appended. Both make
the weight larger, and keep the order of two weights of one item, since equal costs and one audit being the start of the
other would need insertions for nothing. So Knuth's order holds: the least item of the agenda is final when popped.

Long conversations are cut into blocks. A block's ``Span`` says for each state before and after it what the lightest
derivation costs, and how the audits from one state rank among each other; audits themselves are not compared across blocks.
Spans of adjacent blocks combine to the span of both: a deduction with two antecedents.
"""
from __future__ import annotations

from heapq import heappop, heappush

E, S, U, A = range(4)
NONE = -1
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after a turn of this kind is put out; others can't follow.
AFTER = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The one turn that may be inserted or made by a change of role.
TURN = {E: "u", S: "u", U: "a", A: "u"}
#: Insertions that end the conversation from a state.
CLOSING = (0, 2, 1, 0)
NAMES = {"u": "user", "a": "assistant"}
DROP, CUT = 1, 2  # faults: row must go, row is truncated


def lightest(rows: list[tuple[str, int]], entry: int) -> list[tuple[int, str] | None]:
    """Per state after the rows, the least (cost, audit) from the entry state; a row is (initial of its role, fault).

    Insertions stand before the row that follows them, so audits end with a row's letter.
    """
    n = len(rows)
    final: list[tuple[int, str] | None] = [None] * 4
    left = 4
    # weight, rows done, state, whether a row's letter came last
    agenda: list[tuple[int, str, int, int, bool]] = [(0, "", 0, entry, True)]
    done = set()
    while agenda and left:
        cost, audit, i, q, row_last = heappop(agenda)
        if (i, q, row_last) in done:
            continue
        done.add((i, q, row_last))
        if i == n:
            if final[q] is None:
                final[q] = (cost, audit)
                left -= 1
            continue
        initial, fault = rows[i]
        turn = TURN[q]
        after = AFTER[q, turn]
        heappush(agenda, (cost + INSERT, audit + "I", i, after, False))
        heappush(agenda, (cost + DELETE, audit + "D", i + 1, q, True))
        if fault != DROP:
            more = TRUNCATED if fault == CUT else 0
            heappush(agenda, (cost + REROLE + more, audit + "R", i + 1, after, True))
            if (q, initial) in AFTER:
                heappush(agenda, (cost + KEEP + more, audit + "K", i + 1, AFTER[q, initial], True))
    return final


def _ranks(keys: list) -> list[int]:
    """Place of each key among those that are there."""
    order = {k: i for i, k in enumerate(sorted(k for k in keys if k is not None))}
    return [NONE if k is None else order[k] for k in keys]


#: A span is 16 costs by state before and after (NONE: none), then 16 ranks of audits among those of one state before.
Span = list[int]
IDENTITY: Span = [0 if p == q else NONE for p in range(4) for q in range(4)] + [0 if p == q else NONE for p in range(4) for q in range(4)]


def span(rows: list[tuple[str, int]], entries: tuple[int, ...] = (E, S, U, A)) -> Span:
    costs, ranks = [NONE] * 16, [NONE] * 16
    for p in entries:
        found = lightest(rows, p)
        costs[4 * p:4 * p + 4] = [NONE if f is None else f[0] for f in found]
        ranks[4 * p:4 * p + 4] = _ranks([None if f is None else f[1] for f in found])
    return costs + ranks


def middle(x: Span, y: Span, p: int, q: int) -> int:
    """The state between two spans on the lightest way from p to q, or NONE."""
    ways = [(x[4 * p + r] + y[4 * r + q], x[16 + 4 * p + r], r) for r in range(4) if x[4 * p + r] >= 0 and y[4 * r + q] >= 0]
    return min(ways)[2] if ways else NONE


def combine(x: Span, y: Span) -> Span:
    costs, ranks = [NONE] * 16, [NONE] * 16
    for p in range(4):
        if all(c < 0 for c in x[4 * p:4 * p + 4]):
            continue
        keys: list = [None] * 4
        for q in range(4):
            r = middle(x, y, p, q)
            if r >= 0:
                costs[4 * p + q] = x[4 * p + r] + y[4 * r + q]
                keys[q] = (x[16 + 4 * p + r], y[16 + 4 * r + q])
        ranks[4 * p:4 * p + 4] = _ranks(keys)
    return costs + ranks


def goal(whole: Span) -> tuple[int, int]:
    """Cost of a whole conversation and its last state before closing insertions, from nothing."""
    cost, _, q = min((whole[q] + INSERT * CLOSING[q], whole[16 + q], q) for q in range(4) if whole[q] >= 0)
    return cost, q


def play(rows: list[tuple[str, int]], entry: int, last: int) -> tuple[str, list[tuple[int, str, str]]]:
    """The audit of a block between known states, and per row put out: its index, the turns inserted before it, and its new initial.

    The new initial is empty for kept rows.
    """
    _, audit = lightest(rows, entry)[last]
    out, q, i, before = [], entry, 0, ""
    for letter in audit:
        if letter == "I":
            before += TURN[q]
            q = AFTER[q, TURN[q]]
            continue
        if letter == "K":
            out.append((i, before, ""))
            before, q = "", AFTER[q, rows[i][0]]
        elif letter == "R":
            out.append((i, before, TURN[q]))
            before, q = "", AFTER[q, TURN[q]]
        elif before:
            out.append((NONE, before, ""))
            before = ""
        i += 1
    return audit, out


def closing(q: int) -> str:
    """Turns inserted at the end."""
    out = ""
    for _ in range(CLOSING[q]):
        out += TURN[q]
        q = AFTER[q, TURN[q]]
    return out
