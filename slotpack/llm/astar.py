"""Cheapest edits of a conversation by iterative-deepening A*.

A conversation is read turn by turn; before a turn empty turns may be inserted, and the turn itself is
kept, reroled or deleted. The role initials of the result must match ``(s?(ua)+)?``, an automaton of four
states. The search goes depth first in ASCII order of the edit initials (D, I, K, R) under a cost bound;
when it fails, the bound rises to the least estimate that went beyond it. A table of failed states holds,
for each (turn, state), the largest rest of the bound that led nowhere; it stays valid over the bounds.
The first accepting path is the answer: cheapest, and of equally cheap ones the least in ASCII order.

The estimate never exceeds the true cost: deletions that are required, one for each truncated turn, and
two for each of the most faults that share no turn (a role that cannot stand, or two neighbours that
cannot follow each other).
"""

from __future__ import annotations

from collections.abc import Sequence

#: States: nothing yet, after s, after u, after a; the empty conversation and one ending in a are accepted.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after each initial that may follow a state.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State and role of a turn that is inserted or reroled in a state.
MADE = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
LEGAL = {"su", "ua", "au"}
#: Insertions that end a conversation well in each state.
ENDINGS = ("", "II", "I", "")


def estimates(initials: Sequence[str], doomed: Sequence[bool], truncated: Sequence[bool]) -> list[int]:
    """Least cost of the turns from each one on, whatever the state."""
    n = len(initials)
    out, faults, following = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
    forced, after = 0, n  # ``after``: the next turn that need not be deleted
    for i in range(n - 1, -1, -1):
        if doomed[i]:
            forced += DELETE
        else:
            forced += TRUNCATED * bool(truncated[i])
            faults[i] = faults[after] + (initials[i] not in ("s", "u", "a"))
            if after < n and initials[i] + initials[after] not in LEGAL:
                faults[i] = max(faults[i], faults[following[after]] + 1)
            following[i], after = after, i
        out[i] = forced + 2 * faults[after]
    return out


def cheapest(initials: Sequence[str], doomed: Sequence[bool], truncated: Sequence[bool], start: int = START,
             goal: int | None = None) -> tuple[int, str] | None:
    """(cost, edit initials) from state ``start`` to state ``goal`` after the last turn, or None.

    Without ``goal`` the conversation ends there: insertions after the last turn complete it. With one,
    nothing is inserted after the last turn.
    """
    n = len(initials)
    if goal in (START, SYSTEM):  # nothing, or one system turn, survives
        if start not in (START, goal):
            return None
        estimate = [max(0, DELETE * (n - i - (goal != start))) for i in range(n + 1)]
    else:
        estimate = estimates(initials, doomed, truncated)
    ends = [2 * len(e) if goal is None else (0 if q == goal else None) for q, e in enumerate(ENDINGS)]
    worst = sum(DELETE + REROLE + INSERT for _ in range(n)) + 3 * INSERT
    failed: dict[tuple[int, int], int] = {}
    bound = estimate[0]
    while bound <= worst:
        found, beyond = _search(initials, doomed, truncated, start, ends, estimate, bound, failed)
        if found is not None:
            return found
        if beyond is None:
            return None
        bound = beyond
    return None


def _edits(i: int, q: int, inserted: int, initials: Sequence[str], doomed: Sequence[bool], truncated: Sequence[bool]):
    """(initial, cost, next turn, next state, insertions before it) in ASCII order."""
    yield "D", DELETE, i + 1, q, 0
    if inserted < 2:  # more would come back to the same state
        yield "I", INSERT, i, MADE[q][0], inserted + 1
    if not doomed[i]:
        extra = TRUNCATED * bool(truncated[i])
        if initials[i] in FOLLOWS[q]:
            yield "K", KEEP + extra, i + 1, FOLLOWS[q][initials[i]], 0
        yield "R", REROLE + extra, i + 1, MADE[q][0], 0


def _search(initials, doomed, truncated, start, ends, estimate, bound, failed):
    """One depth-first pass: the first accepting path within ``bound``, else the least estimate beyond it."""
    n, beyond = len(initials), None
    path: list[str] = []
    stack = [(0, start, 0, 0, None)]  # turn, state, insertions just made, cost so far, edits left to try
    while stack:
        i, q, inserted, cost, edits = stack[-1]
        if edits is None:
            if i == n:
                if ends[q] is not None:
                    whole = cost + ends[q]
                    if whole <= bound:
                        return (whole, "".join(path) + (ENDINGS[q] if ends[q] else "")), None
                    beyond = whole if beyond is None else min(beyond, whole)
                stack.pop()
                if path:
                    path.pop()
                continue
            edits = _edits(i, q, inserted, initials, doomed, truncated)
            stack[-1] = (i, q, inserted, cost, edits)
        for name, price, i2, q2, inserted2 in edits:
            total = cost + price
            if total + estimate[i2] > bound:
                beyond = total + estimate[i2] if beyond is None else min(beyond, total + estimate[i2])
                continue
            if failed.get((i2, q2, inserted2), -1) >= bound - total:
                continue
            path.append(name)
            stack.append((i2, q2, inserted2, total, None))
            break
        else:
            failed[i, q, inserted] = bound - cost
            stack.pop()
            if path:
                path.pop()
    return None, beyond
