import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from slotpack.llm import exact_dedup


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[_norm(t)].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


def _got(df):
    return [(r.doc_id, r.keep_id, r.size, r.digest.hex()) for r in df.collect()]


def test_edge_rows(frame, edge_rows):
    out = exact_dedup.exact_groups(frame(edge_rows))
    assert sorted(map(str, _got(out))) == _expected(edge_rows)
    kept = [r for r in out.collect() if r.kept]
    assert len({r.digest for r in kept}) == len(kept) == len({_norm(t) for _, t in edge_rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_any_split_into_snapshot_and_batch_gives_the_same(frame):
    rows = [(i, f"text  {i % 7}\n{'x' * (i % 3)}") for i in range(60)] + [(100 + i, "same \t text") for i in range(300)]
    expected = _expected(rows)
    for cut in (-1, 30, 150, 10_000):
        out = exact_dedup.exact_groups(frame(rows), F.col("doc_id") < cut)
        assert sorted(map(str, _got(out))) == expected


def test_kept_rows_keep_their_columns(frame, edge_rows):
    docs = frame(edge_rows)
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(_norm(r.text) for r in out.collect()) == sorted({_norm(t) for _, t in edge_rows})


def test_digest_collisions_are_told_apart_by_bytes(spark):
    digest = bytearray(b"d" * 32)
    out = spark.createDataFrame([(0, 1, digest, 1, 3, True), (1, 2, digest, 1, 3, False), (2, 3, digest, 1, 3, False)],
                                "row long, doc_id long, digest binary, keep_id long, size long, kept boolean")
    unequal = spark.createDataFrame([(2, digest, "other"), (3, digest, "other")], "doc_id long, digest binary, norm string")
    got = {r.doc_id: (r.keep_id, r.size, r.kept) for r in exact_dedup._apart(out, unequal).collect()}
    assert got == {1: (1, 1, True), 2: (2, 2, True), 3: (2, 2, False)}


def test_empty_table(frame):
    assert exact_dedup.exact_groups(frame([])).collect() == []
    assert exact_dedup.keep_first(frame([])).collect() == []


def test_ids_that_are_no_numbers(spark):
    rows = [("b", "one  text"), ("a", "one text"), ("c", "other"), (None, "other"), ("d", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.keep_id, r["size"], r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {"a": ("a", 2, True), "b": ("a", 2, False), "c": ("c", 2, True), None: ("c", 2, False), "d": ("d", 1, True)}
