"""Incremental corpus analysis: layout documents landing in a folder, bulk rows appended per batch.

The analysis is stateless per document, so each micro-batch runs the same batch operators
(parse -> layout tables -> analysis -> bulk rows) in ``foreachBatch`` and appends to a Parquet
table. The caller names the folder of the stream's progress; with the same folder a restarted driver
resumes without re-emitting rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.operators import corpus
from slotpack.plans.analysis import Analysis
from slotpack.session import materialize
from slotpack.sources import layout_json


def _batch_rows(batch: DataFrame) -> DataFrame:
    docs = layout_json.parse_documents(batch, text="json", file="file")
    t = layout_json.layout_tables(docs, keep=lambda d: materialize(d, "batch"))
    a = Analysis(t["contracts"], t["entries"], t["structs"], t["struct_fields"])
    failed = t["file_status"].where(F.col("status") == "ERROR").select("file", "error")
    return a.bulk_rows(file_errors=failed)


def write_batch(batch: DataFrame, batch_id: int, sink_dir: str, sums_dir: str | None = None) -> None:
    """Bulk rows of one micro-batch to ``sink_dir`` and its partial sums to ``sums_dir``.

    Both are partitioned by batch: a retried batch overwrites its own partition only.
    """
    rows = _batch_rows(batch) if sums_dir is None else materialize(_batch_rows(batch), "batch-rows")
    tables = [(rows, sink_dir)] + ([(corpus.partial_sums(rows), sums_dir)] if sums_dir else [])
    for table, folder in tables:
        (table.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder))


def start(spark: SparkSession, source_dir: str, sink_dir: str, progress_dir: str, trigger_once: bool = False,
          max_files_per_trigger: int = 1000, sums_dir: str | None = None):
    """Watch ``source_dir`` for layout JSON files; append bulk rows to Parquet at ``sink_dir``.

    With ``sums_dir`` each batch also leaves its partial sums, from which ``corpus.bulk_summary_of`` and
    ``corpus.dataset_report_of`` give the reports of all batches without reading the rows again.
    """
    stream = (spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())]))
              .option("wholetext", True).option("maxFilesPerTrigger", max_files_per_trigger)
              .text(source_dir)
              .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")))
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, sink_dir, sums_dir))
    writer = writer.option("checkpointLocation", progress_dir)
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="30 seconds")
    return writer.start()
