import inspect
import re

import corpus_pipeline
from slotpack.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_the_last_one_packs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    from slotpack.llm.common import store
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, docs, SF), name)
        assert out.schema.names == docs.schema.names and out.exceptAll(docs).isEmpty()
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] > 0
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = [" ".join(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    assert not any(x in t for x in items for t in own)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_equals_its_stages(spark):
    from slotpack.llm.common import store
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
    rows = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*rows).collect()))
    assert got == sorted(map(tuple, docs.select(*rows).collect())) and got


def _tables(spark, folder, documents, labels=(), benchmark=()):
    columns = ", ".join(f"{c} int" for c in ("row", "whole", "own_id", "digest", "key", "hash", "item", "x", "score"))
    spark.createDataFrame([(*d, "en", "s", None, *range(9)) for d in documents], f"doc_id long, text string, lang string, "
                          f"source string, n_chars long, {columns}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_edge_rows_and_empty_tables(spark, edge_rows, tmp_path):
    """Labels of one class only keep every document; nulls, repeated rows, long texts and clashing columns pass all stages."""
    folder = _tables(spark, tmp_path / "a", edge_rows + edge_rows[:3], [(i, 1, 0) for i in range(1, 11)], [(1, None), (2, "text without an id")])
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} >= {1, 7, 9, 10} and sum(p.doc_id == 8 for p in pieces) == 0
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "b", [])).collect() == []


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert all(inspect.getdoc(f) for f in queries.QUERIES.values())
