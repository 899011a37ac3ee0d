"""Benchmark: headline queries on the stand-in corpus at $BENCH_SF_DIR, one JSON line on stdout.

The corpus tables (contracts, entries, structs, struct members) are built once from the driver
tables and materialised (timed as ``ingest``); each headline query then runs on them. One untimed
warm-up pass over the smallest tables (sf0.001, when present) starts the JVM code paths and the
Python workers first, so the timings are of the queries, not of process start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from slotpack.functions import nextfit  # noqa: E402
from slotpack.operators import corpus, metrics, packing, profile  # noqa: E402
from slotpack.plans.analysis import Analysis  # noqa: E402
from slotpack.session import local_session, materialize, table_path  # noqa: E402
from slotpack.sources import bulk_csv, layout_json, standin  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    times: dict[str, float] = {}
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(warm):
        wc = standin.Corpus(spark, warm)
        wa = Analysis(wc.contracts, wc.entries, wc.structs, wc.struct_fields)
        corpus.bulk_summary(wa.bulk_rows()).collect()
        metrics.issues(wc.entries).count()

    def run(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    c = standin.Corpus(spark, sf_dir)
    run("ingest", lambda: (c.entries, c.struct_fields, c.contracts))
    e = c.entries
    run("declared_layout", lambda: nextfit.positions(e, ["contract_id"], "ordinal", "number_of_bytes")
        .agg(F.sum("slot")).collect())
    run("current_metrics", lambda: metrics.current_slots(e, c.contracts).join(metrics.current_waste(e), "contract_id")
        .agg(F.sum("current_slots"), F.sum("current_wasted")).collect())
    run("issues", lambda: metrics.issues(e).groupBy("code", "severity").count().collect())
    run("pack_ffd", lambda: packing.pack_ffd(
        packing.classify(e).where(F.col("cls") == "packable"), ["contract_id"], "ordinal", "number_of_bytes")
        .agg(F.count_distinct("contract_id", "bin")).collect())
    a = Analysis(c.contracts, e, c.structs, c.struct_fields)
    run("contract_report", lambda: a.report().agg(F.sum("recommended_slots"), F.sum("struct_saved_slots")).collect())
    rows = a.bulk_rows()
    run("bulk_summary", lambda: corpus.bulk_summary(rows).collect())
    run("dataset_report", lambda: corpus.dataset_report(rows).collect())
    run("top_contracts", lambda: corpus.top_contracts_web(rows).collect())
    path = table_path(spark, "bench-csv")
    run("bulk_csv", lambda: (bulk_csv.write_bulk_csv(rows, path),
                             corpus.dataset_report(bulk_csv.read_bulk_csv(spark, path)).collect()))
    run("pack_exact", lambda: packing.pack_exact(
        packing.classify(e).where(F.col("cls") == "packable"), ["contract_id"], "ordinal", "number_of_bytes")
        .agg(F.count_distinct("contract_id", "bin")).collect())
    src = materialize(standin.sources(c.contracts, e), "bench-sources")
    run("source_profile", lambda: profile.profile(src).agg(F.sum("functions_removed"), F.sum("types_replaced")).collect())
    docs = materialize(layout_json.to_documents(c.contracts, e, c.struct_fields, c.structs), "bench-documents")
    run("json_ingest", lambda: layout_json.layout_tables(
        layout_json.parse_documents(docs), keep=lambda d: materialize(d, "bench-layouts"))["entries"]
        .agg(F.sum("number_of_bytes")).collect())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "slotpack_headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
