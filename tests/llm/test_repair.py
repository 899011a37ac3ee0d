import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from slotpack.llm import astar, repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, ckey int, position int, chunk int, rows int"


def by_table(initials, doomed, cut, start=0, goal=None):
    """Cheapest, then ASCII-least edits from the costs of every suffix and state."""
    n, none = len(initials), (10 ** 9, "~")
    if goal is None:
        best = [(2 * len(e), e) for e in astar.ENDINGS]
    else:
        best = [(0, "") if q == goal else none for q in range(4)]
    for i in range(n - 1, -1, -1):
        def turn(q, best=best, i=i):
            c = [(best[q][0] + 3, "D" + best[q][1])]
            if not doomed[i]:
                to = astar.FOLLOWS[q].get(initials[i])
                if to is not None:
                    c.append((best[to][0] + cut[i], "K" + best[to][1]))
                to = astar.MADE[q][0]
                c.append((best[to][0] + cut[i] + 2, "R" + best[to][1]))
            return min(c)
        turns = [turn(q) for q in range(4)]
        made = [astar.MADE[q][0] for q in range(4)]
        best = [min(turns[q], (turns[made[q]][0] + 2, "I" + turns[made[q]][1]),
                    (turns[made[made[q]]][0] + 4, "II" + turns[made[made[q]]][1])) for q in range(4)]
    return None if best[start][0] >= 10 ** 8 else best[start]


def test_search_equals_table():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.choice([0, 1, 2, 3, 5, 8, 20])
        initials = [rng.choice(["s", "u", "a", "t", " ", ""][:rng.choice([3, 6])]) for _ in range(n)]
        doomed = [rng.random() < 0.15 for _ in initials]
        cut = [not d and rng.random() < 0.2 for d in doomed]
        for start in range(4):
            for goal in (0, 1, 2, 3, None):
                assert astar.cheapest(initials, doomed, cut, start, goal) == by_table(initials, doomed, cut, start, goal)


def test_estimate_never_exceeds_the_cost():
    rng = random.Random(4)
    for _ in range(300):
        initials = [rng.choice("suat") for _ in range(rng.randint(0, 15))]
        doomed = [rng.random() < 0.2 for _ in initials]
        cut = [not d and rng.random() < 0.2 for d in doomed]
        for k, least in enumerate(astar.estimates(initials, doomed, cut)):
            assert least <= min(by_table(initials[k:], doomed[k:], cut[k:], q)[0] for q in range(4))


def brute(rows):
    """Result per conv_id, written from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in own.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\x1f{r[2]}".encode()).hexdigest()))
        after = []
        for turn, role, text in turns:
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        fault = []
        for k, (_, role, text) in enumerate(after):
            body = text.strip(WHITE)
            fault.append("b" if not body else "d" if (role, text) in [r[1:] for r in after[:k]] else "t" if body[-1] not in ".!?" else "")
        initials = [r[1][:1] for r in after]
        cost, audit = by_table(initials, [f in ("b", "d") for f in fault], [f == "t" for f in fault])
        state, left, lines = 0, iter(after), []
        for e in audit:
            _, role, text = (0, "", "") if e == "I" else next(left)
            if e != "D":
                if e == "K":
                    state = astar.FOLLOWS[state][role[:1]]
                else:
                    state, role = astar.MADE[state]
                lines.append(f"{role}:{text}")
        known = [r[0] for r in after if r[0] is not None]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, fault.count("b"), fault.count("d"),
                     fault.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Hello there.", "Is it so?", "no end", "", " \n", None, "Ünï 日本語!", f"text {rng.random()}."])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, text))
    return rows


def got(spark, rows):
    out = repair.repaired(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: tuple(r[c] for c in [*repair.COUNTS, "audit", "repaired_sha256"]) for r in out}


@pytest.mark.parametrize("chunk", [64, 3])
def test_repaired_equals_definition(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = talk(chunk, 60, 14) + [(None, 1, "user", "Who?"), (None, None, None, None), (None, 2, "assistant", "I.")]
    assert got(spark, rows) == brute(rows)


def test_long_conversation_and_repeated_rows(spark):
    rows = talk(5, 1, 400) * 2 + [(1, t, "user" if t % 2 == 0 else "assistant", f"All good {t}.") for t in range(300)]
    rows += [(2, 7, "user", "word " * 100000 + "end.")] * 70
    assert got(spark, rows) == brute(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert got(spark, [(9, gone, "user", "Hello.")]) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, rows) == brute(rows)
