"""Bulk report CSV sink and scan.

The 18 named columns, RFC-4180 quoting (quotes doubled). The scan reads every column as text with
an explicit schema plus ``_corrupt_record``. A row that has a corrupt record has another number of
fields than 18; of these the ones with fewer fields than 18 (counted outside quotes) are dropped, longer
ones are kept. Rows of 18 fields are kept whatever is empty, blank lines are skipped, bad integers
become 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.schema import BULK_COLUMNS, BULK_INT_COLUMNS


def write_bulk_csv(rows: DataFrame, path: str) -> None:
    """Write bulk rows (header, quoted where needed, quotes doubled)."""
    (rows.select(*BULK_COLUMNS).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
     .csv(path))


def read_bulk_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan bulk rows; short rows dropped, integers parsed leniently (0 when unparsable)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in BULK_COLUMNS]
                          + [T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("ignoreLeadingWhiteSpace", False).csv(path))
    unquoted = F.regexp_replace("_corrupt_record", r'"(?:[^"]|"")*+"', "")
    fields = F.regexp_count(unquoted, F.lit(",")) + 1
    kept = raw.where(F.col("_corrupt_record").isNull() | (fields >= len(BULK_COLUMNS)))
    return kept.select(
        *[F.coalesce(F.trim(F.col(c)).try_cast("int"), F.lit(0)).cast("bigint").alias(c) if c in BULK_INT_COLUMNS
          else F.coalesce(F.col(c), F.lit("")).alias(c) for c in BULK_COLUMNS])
