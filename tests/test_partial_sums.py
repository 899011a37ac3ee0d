"""Reports from partial sums of batches equal the one-shot reports, also when a batch is written twice."""

import json

import pytest
from pyspark.sql import functions as F

from slotpack.operators import corpus
from slotpack.streaming import layouts


def _document(k):
    sizes = [(1, "t_u8"), (32, "t_u256"), (1, "t_u8")] * (1 + k % 9)
    storage = [{"astId": i, "contract": "C", "label": f"v{i}", "offset": 0, "slot": str(i), "type": t} for i, (_, t) in enumerate(sizes)]
    types = {t: {"encoding": "inplace", "label": t, "numberOfBytes": str(b)} for b, t in sizes}
    if k % 7 == 3:
        return "{"
    return json.dumps({"contracts": {"A.sol": {f"C{k}": {"storageLayout": {"storage": storage, "types": types}}}}})


def test_ten_batches_one_replayed(spark, tmp_path):
    rows = [(f"{('real', 'synthetic', 'other')[k % 3]}/{k}.json", _document(k)) for k in range(30)]
    sink, sums = str(tmp_path / "rows"), str(tmp_path / "sums")
    frame = lambda part: spark.createDataFrame(part, "file string, json string")
    for b in [*range(5), 3, *range(5, 10)]:
        layouts.write_batch(frame(rows[3 * b:3 * b + 3]), b, sink, sums)
    once = layouts._batch_rows(frame(rows)).persist()
    merged = spark.read.parquet(sums)
    assert corpus.bulk_summary_of(merged).first() == corpus.bulk_summary(once).first()
    assert corpus.dataset_report_of(merged).first() == corpus.dataset_report(once).first()
    assert spark.read.parquet(sink).count() == once.count()
    assert merged.count() <= 10 * 10  # a few rows per batch, whatever it holds
    cube = {(r.kind, r.tag, r.status): r.rows for r in corpus.savings_cube(merged).collect()}
    want = {(r.k, r.status): r.n for r in once.groupBy(F.substring_index("file", "/", 1).alias("k"), "status").agg(F.count("*").alias("n")).collect()}
    assert all(cube[k, "all", s] == n for (k, s), n in want.items()) and cube["all", "all", "all"] == once.count()


@pytest.mark.parametrize("report", ["bulk_summary", "dataset_report"])
def test_no_rows(spark, report):
    none = layouts._batch_rows(spark.createDataFrame([], "file string, json string"))
    assert getattr(corpus, f"{report}_of")(corpus.partial_sums(none)).first() == getattr(corpus, report)(none).first()
