"""Source-file scans and lookups (O01, O04, O05) and verified-source payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.functions import columns as C
from slotpack.functions.columns import once


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.sol`` file under ``root`` (recursive, ``*.preprocessed.sol`` excluded) as
    (file, text) with ``file`` relative to ``root`` using ``/``."""
    base = re.sub(r"^file:/*(?=/)", "", root.rstrip("/"))
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sol")
          .option("wholetext", True).text(root))
    # the scan reports URL-encoded paths; a plus sign is one there
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    plain = F.regexp_replace(path, r"^file:/*(?=/)", "")
    rel = F.when(plain.startswith(base + "/"), plain.substr(F.lit(len(base) + 2), F.length(plain))).otherwise(plain)
    return (df.select(F.translate(rel, "\\", "/").alias("file"), F.col("value").alias("text"))
            .where(~F.col("file").endswith(".preprocessed.sol")))


def source_at(sources: DataFrame, path: str) -> DataFrame:
    """The source of one relative path (0 rows when missing)."""
    return sources.where(F.col("file") == F.lit(path.replace("\\", "/")))


def sources_for(paths: DataFrame, sources: DataFrame, path_col: str = "file") -> DataFrame:
    """O05 for many paths at once: an inner join on the relative path (missing paths: no row)."""
    norm = paths.withColumn("_path", F.translate(F.col(path_col), "\\", "/"))
    return (norm.join(sources.select(F.col("file").alias("_path"), "text"), "_path")
            .drop("_path"))


EXAMPLE_INDEX = T.ArrayType(T.StructType([
    T.StructField(n, T.StringType()) for n in ("id", "title", "tag", "kind", "description", "file")]))


def read_example_index(spark: SparkSession, path: str) -> DataFrame:
    """The example index (a JSON array of {id, title, tag, kind, description, file})."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", EXAMPLE_INDEX)).alias("e")).select("e.*")


def examples(index: DataFrame, sources: DataFrame) -> DataFrame:
    """Example metadata joined to its source text by relative file name (inner)."""
    return (index.join(sources.select("file", F.col("text").alias("source")), "file")
            .select("id", "title", "tag", "kind", "description", "source"))


# ---------------------------------------------------------------------------
# Verified-source payloads
# ---------------------------------------------------------------------------
_SOURCES_OBJ = "struct<sources: map<string, string>>"
_SOURCES_MAP = "map<string, string>"
_CONTENT = "struct<content: string>"


#: Control characters and white space.
_BLANK = "".join(map(chr, range(0x21)))


def _stripped(text: Column) -> Column:
    """Without leading and trailing control characters and white space."""
    return F.btrim(text, F.lit(_BLANK))


def _files(trimmed: Column) -> Column:
    """File texts of a JSON payload by path, perhaps in a second pair of braces or under a ``sources`` key."""
    inner = F.when(trimmed.startswith("{{") & trimmed.endswith("}}"),
                   trimmed.substr(F.lit(2), F.length(trimmed) - 2))
    json_text = F.coalesce(inner, trimmed)
    by_key = F.from_json(json_text, _SOURCES_OBJ)["sources"]
    has_key = F.get_json_object(json_text, "$.sources").isNotNull()
    return F.when(has_key, by_key).otherwise(F.from_json(json_text, _SOURCES_MAP))


def _contents(files: Column) -> Column:
    """Non-empty contents of the files in document order; entries that are no objects have none."""
    return F.filter(
        F.transform(F.map_entries(files), lambda e: F.coalesce(F.from_json(e["value"], _CONTENT)["content"], F.lit(""))),
        lambda c: c != "")


def _solidity(contents: Column, contract_name: Column) -> Column:
    """The last content that holds ``contract <Name>``, else all of them."""
    name = F.coalesce(contract_name, F.lit(""))
    matches = F.filter(contents, lambda c: c.contains(F.concat(F.lit("contract "), name)))
    # the last match or null, from a list that is filtered once
    main = F.when(_stripped(name) != "", F.try_element_at(matches, F.lit(-1)))
    every = F.array_join(F.transform(contents, lambda c: F.concat(c, F.lit("\n"))), "")
    return F.coalesce(main, every)


def verified_sources(payloads: DataFrame) -> DataFrame:
    """O06/O07 over (address, contract_name, source_code[, link, file_name]).

    O06, the Solidity text of a payload: plain text is returned as is. JSON (optionally wrapped in a second pair
    of braces, optionally under a ``sources`` key) yields the content of the last file containing
    ``contract <Name>``, else every non-empty content followed by a newline, in document order. Each step is
    computed once per payload.
    """
    d = payloads.select("*", once(_stripped(F.col("source_code"))).alias("_trimmed"))
    multi = F.col("_trimmed").startswith("{")
    d = d.select("*", once(F.when(multi, _contents(_files(F.col("_trimmed"))))).alias("_contents"))
    out = d.select(
        "address", "contract_name", multi.alias("multi_file"),
        F.when(~multi, F.col("source_code")).otherwise(_solidity(F.col("_contents"), F.col("contract_name"))).alias("solidity"),
        *([C.address_from_text("link").alias("link_address")] if "link" in payloads.columns else []),
        *([C.address_from_path("file_name").alias("path_address")] if "file_name" in payloads.columns else []),
    )
    return out
