from collections import defaultdict

from pyspark.sql import functions as F

from slotpack.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def _expected(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].add((t or 0, r or "", x or ""))
    own = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, v in own.items():
        if any(len(w) > len(v) and w[:len(v)] == v for w in own.values()) or min(d for d in own if own[d] == v) != c:
            continue
        out[c] = (len(v), sum(w == v for w in own.values()), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in v))
    return out


def _got(df):
    parts = defaultdict(list)
    for r in df.collect():
        parts[r.conv_id].append(r)
    return {c: (v[0].n_turns, v[0].copies, "".join(r.rendered for r in sorted(v, key=lambda r: r.part))) for c, v in parts.items()}


def test_snapshots_collapse(spark):
    rows = []
    for c in range(40):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 4}") for t in range(1 + c % 7)]
    rows += [(100 + c, 0, "user", "hello") for c in range(200)]
    rows += [(400, 0, "user", "hello"), (400, 1, "assistant", "hi"), (400, 1, "assistant", "hi")]
    rows += [(500, None, None, None), (501, 3, "user", "late start"), (502, 7, "user", "late start"), (502, 9, "a", "b"),
             (None, 0, "user", "lost"), (503, 0, "x", "tie b"), (503, 0, "x", "tie a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit(3)).withColumn("part", F.lit("p"))
    assert _got(chat.formatted(df)) == _expected(rows)


def test_long_conversation_spans_chunks_and_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(1500)] + [(2, t, "user", f"t{t}") for t in range(1200)] + \
           [(3, t, "user", f"t{t}" if t != 700 else "other") for t in range(1200)]
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    assert _got(out) == _expected(rows)
    assert sorted(r.part for r in out.where("conv_id = 1").collect()) == list(range(6))


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).collect() == []
