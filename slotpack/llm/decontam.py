"""Benchmark decontamination by template windows, with DataFrame functions only.

A text becomes a template: every number, name and unit is replaced by a typed placeholder, the rest is
lower-cased and cut into words. Windows of WINDOW template words are hashed and joined with those of the
benchmark items; the slots of matching windows are paired, and one item value must stand for one and the
same document value along an alignment. So a question with other numbers or names is caught, and a text
that merely has the same shape is not.

A number is one placeholder with its separators and decimals, a run of capitalised words after another
word in a sentence is one name, a unit follows a number; white space of any kind is one space. There are
three streams of windows, so that copies meet whatever happened to their letter case:

* plain: numbers and units are slots, everything is lower-cased (names are ordinary words);
* named: names are slots too, for item windows that have some;
* exact: the words with their values, for windows with literals in fewer than half of their places, and
  for items of fewer than WINDOW words, which are one window. Items of fewer than SHORTEST words count
  only where they fill a whole line or sentence.

An item is found where an alignment (windows whose shift differs by at most SLACK) holds at least COVER of
its windows with consistent slots, or RUN of them with the item's own values. A stock phrase that an item
shares with other texts is neither. Pairs of document and item come from the item's rarest windows only,
as many as a match cannot miss all of, so a window that very many items and documents share makes no pairs.

The window hashes are broadcast in blocks of at most BLOCK rows, one pass over the documents for each.

Defined results: null text counts as empty and matches nothing, an item without words is never found; null
ids are kept as ids (one group); repeated rows count once per (doc_id, item_id); texts of any length are
read whole; other columns are not read (``drop_contaminated`` returns them unchanged); empty tables give
no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotpack.llm.common import store, whole_text, with_ids

WINDOW = 8
SHORTEST = 5
COVER = 0.5
RUN = 18
SLACK = 32
#: Rows of the benchmark side (8 bytes each) that one broadcast may hold.
BLOCK = 1_000_000
PLAIN, NAMED, EXACT, WHOLE = range(4)

UNITS = ("%|percent|mm|cm|m|km|mg|g|kg|t|ml|l|s|ms|min|h|kb|mb|gb|mph|kmh|inch|inches|feet|foot|ft|yards|miles|mile|"
         "meters|metres|kilometers|kilometres|grams|kilograms|lb|lbs|pounds|oz|ounces|liters|litres|gallons|seconds|minutes|"
         "hours|days|weeks|months|years|dollars|cents|euros|degrees")
_THOUSANDS = r"(?<=\p{N}),(?=\p{N}{3}(?!\p{N}))"
_POINT = r"(?<=\p{N})\.(?=\p{N})"
_NUMBER = r"(?<![\p{L}\p{N}])\p{N}+(?:p\p{N}+)*"
_UNIT = rf"(0num[\p{{N}}p]+) ?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])"
_NAME = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
_RUN = r"(0name\p{L}+) (?=0name)"
_SLOT = r"(?<![\p{L}\p{N}])(0num|0unit|0name)[\p{L}\p{N}]+"
_BOUND = r"[.!?:;|\r\n\"“”]+"


def numbered(text: Column) -> Column:
    """The text with each number and unit written as its type and value: 0num12, 0num3p5, 0unitkm."""
    s = F.regexp_replace(F.regexp_replace(text, _THOUSANDS, ""), _POINT, "p")
    s = F.regexp_replace(s, _NUMBER, "0num$0")
    return F.regexp_replace(F.regexp_replace(s, _UNIT, "$1 0unit$2"), "0unit%", "0unitpercent")


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}]+", " ")


def with_names(marked: Column) -> Column:
    """Numbered text with each run of names written as 0name and the names."""
    return F.regexp_replace(F.regexp_replace(marked, _NAME, "0name$0"), _RUN, "$1")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def template(valued: Column) -> Column:
    """Valued text with the values taken out."""
    return F.regexp_replace(valued, _SLOT, "$1")


def streams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, plain and named words with their values (v0, v1) and without (t0, t1), and the numbered text.

    Without any name the named words are empty.
    """
    d = rows.select(*keys, numbered(whole_text()).alias("lines")).withColumn("marked", spaced(F.col("lines")))
    d = d.withColumn("names", with_names(F.col("marked")))
    plain, named = F.lower("marked"), F.when(F.col("names") != F.col("marked"), F.lower("names")).otherwise("")
    return d.select(*keys, "lines", plain.alias("plain"), named.alias("named")).select(
        *keys, "lines", words(F.col("plain")).alias("v0"), words(template(F.col("plain"))).alias("t0"),
        words(F.col("named")).alias("v1"), words(template(F.col("named"))).alias("t1"))


def _starts(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))


def _hash(stream: int, size: int, own: Column) -> Column:
    return F.xxhash64(F.lit(stream * 64 + size), own)


def _wholes(lines: Column) -> Column:
    """Hashes of the lines and sentences of fewer than SHORTEST words."""
    own = F.transform(F.split(F.lower(lines), _BOUND), words)
    few = F.filter(own, lambda w: (F.size(w) > 0) & (F.size(w) < SHORTEST))
    return F.transform(few, lambda w: _hash(WHOLE, 0, w))


def window_hashes(stream: int, size: int) -> Column:
    """Hash of each window of the stream, in order."""
    if stream == WHOLE:
        return _wholes(F.col("lines"))
    own = F.col({PLAIN: "t0", NAMED: "t1", EXACT: "v0"}[stream])
    return F.transform(_starts(F.size(own), size), lambda i: _hash(stream, size, F.slice(own, i, F.lit(size))))


def windows(rows: DataFrame, keys: list[str], stream: int, size: int) -> DataFrame:
    """keys, hash, plain_hash (of the same words), position and slots (null for literals) of each window, one row each."""
    if stream == WHOLE:
        found = F.transform(window_hashes(WHOLE, 0), lambda h: F.struct(
            h.alias("hash"), h.alias("plain_hash"), F.lit(0).alias("position"), F.array().cast("array<string>").alias("slots")))
    else:
        v, own = F.col("v1" if stream == NAMED else "v0"), F.col({PLAIN: "t0", NAMED: "t1", EXACT: "v0"}[stream])
        found = F.transform(_starts(F.size(own), size), lambda i: F.struct(
            _hash(stream, size, F.slice(own, i, F.lit(size))).alias("hash"),
            _hash(PLAIN, size, F.slice(own, i, F.lit(size))).alias("plain_hash"), i.alias("position"),
            F.transform(F.slice(v, i, F.lit(size)), lambda w: F.when(w.rlike(f"^{_SLOT}$"), w)).alias("slots")))
    return rows.select(*keys, F.explode(found).alias("w")).select(*keys, "w.*")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Stored (item, item_id, stream, size, side, hash, position, slots, total, chosen) of all item windows.

    ``side`` is 1 for the named stream and 0 for the others, which share the windows of an item among them;
    ``total`` counts an item's windows of one side, ``chosen`` marks its rarest ones, of which a match has one.
    """
    keys = ["item", "item_id"]
    item = F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit("")).alias("item")
    items = store(streams(benchmark.select(item, "item_id", "text"), keys).withColumn("n", F.size("v0")), "items")
    short = sorted(r[0] for r in items.select("n").where(F.col("n").between(SHORTEST, WINDOW - 1)).distinct().collect())
    parts = []
    for size in (*short, WINDOW):
        own = items.where(F.col("n") >= WINDOW if size == WINDOW else F.col("n") == size)
        literals = F.size(F.filter("slots", lambda s: s.isNull()))
        for stream in (PLAIN, EXACT, NAMED):
            w = windows(own, keys, stream, size)
            enough = literals * 2 >= size
            if stream == EXACT:
                enough = ~enough
            named = (F.lit(stream) == NAMED) & F.exists("slots", lambda s: s.startswith("0name"))
            parts.append(w.where(enough).withColumn("stream", F.lit(stream)).withColumn("size", F.lit(size))
                         .withColumn("named", named))
    few = items.where(F.col("n").between(1, SHORTEST - 1)).select(
        *keys, _hash(WHOLE, 0, F.col("v0")).alias("hash"), F.lit(0).cast("bigint").alias("plain_hash"), F.lit(0).alias("position"),
        F.array().cast("array<string>").alias("slots"), F.lit(WHOLE).alias("stream"), F.lit(0).alias("size"),
        F.lit(False).alias("named"))
    found = reduce(DataFrame.unionByName, [*parts, few]).withColumn("side", (F.col("stream") == NAMED).cast("int"))
    # windows without a name are the plain ones of the named side as well; items without any have no such side
    plain = F.col("named") | (F.col("side") == 0)
    found = (found.withColumn("some", F.max("named").over(Window.partitionBy("item", "side")))
             .where((F.col("side") == 0) | F.col("some")))
    found = store(found.withColumn("stream", F.when(plain, F.col("stream")).otherwise(PLAIN))
                  .withColumn("hash", F.when(plain, F.col("hash")).otherwise(F.col("plain_hash")))
                  .drop("named", "some", "plain_hash"), "windows")
    shared = found.groupBy("hash").agg(F.count_distinct("item").alias("items"))
    own = Window.partitionBy("item", "side")
    needed = F.least(F.ceil(F.col("total") * F.lit(COVER)), F.lit(RUN))
    place = F.row_number().over(own.orderBy("items", "position", "stream", "hash"))
    return store(found.join(shared, "hash").withColumn("total", F.count(F.lit(1)).over(own))
                 .withColumn("chosen", place <= F.col("total") - needed + 1).drop("items"), "benchmark")


def _blocks(known: DataFrame) -> list[DataFrame]:
    """The distinct hashes in broadcast blocks."""
    distinct = store(known.select("hash").distinct(), "hashes")
    many = max(1, math.ceil(distinct.count() / BLOCK))
    return [F.broadcast(distinct.where(F.pmod(F.xxhash64("hash"), F.lit(many)) == k)) for k in range(many)]


def _kinds(known: DataFrame) -> list[tuple[int, int]]:
    """The (stream, size) of the windows, at most three times WINDOW."""
    return sorted((r["stream"], r["size"]) for r in known.select("stream", "size").distinct().collect())


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Stored distinct doc_ids of documents that share a chosen window with the benchmark."""
    chosen = known.where("chosen")
    kinds = _kinds(chosen)
    if not kinds:
        return store(docs.select("doc_id").limit(0), "candidates")
    hashes = F.concat(*[window_hashes(*k) for k in kinds])
    rows = streams(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", F.explode(hashes).alias("hash"))
    found = [rows.join(b, "hash", "left_semi").select("doc_id") for b in _blocks(chosen)]
    return store(reduce(DataFrame.unionByName, found).distinct(), "candidates")


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Stored distinct (doc, doc_id, hash, position, slots): the windows of ``docs`` that some item has too."""
    doc = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("doc")
    keys = ["doc", "doc_id"]
    rows = store(streams(docs.select(doc, "doc_id", "text"), keys), "streams")
    every = reduce(DataFrame.unionByName, [windows(rows, keys, *k) for k in _kinds(known)])
    met = [every.join(b, "hash", "left_semi") for b in _blocks(known)]
    return store(reduce(DataFrame.unionByName, met).select(*keys, "hash", "position", "slots").distinct(), "hits")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, exact): benchmark items found in each document.

    ``windows`` counts the item's windows that the best alignment holds with consistent slots, of
    ``item_windows``; ``exact`` tells that all their slots have the item's own values.
    """
    known = benchmark_windows(benchmark)
    if known.isEmpty():
        return _empty(docs, benchmark)
    near = store(with_ids(docs.select("doc_id", "text"), candidates(docs, known), "left_semi"), "near")
    found = hits(near, known)
    pairs = store(found.select("doc", "hash").distinct().join(known.where("chosen").select("item", "side", "hash"), "hash")
                  .select("doc", "item", "side").distinct(), "pairs")
    wanted = pairs.join(known.select("item", "item_id", "side", "hash", F.col("position").alias("item_position"),
                                     F.col("slots").alias("item_slots"), "total"), ["item", "side"])
    shift = F.col("position") - F.col("item_position")
    near_shifts = F.array(F.floor(shift / SLACK) * 2, F.floor((shift + SLACK // 2) / SLACK) * 2 + 1)
    paired = F.array_distinct(F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["slots"].isNotNull()))
    met = store(wanted.join(found, ["doc", "hash"]).select(
        "doc", "doc_id", "item", "item_id", "side", "total", "item_position", paired.alias("paired"),
        F.explode(near_shifts).alias("at")), "met")
    key = ["doc", "item", "side", "at"]
    broken = (met.select(*key, F.explode("paired").alias("p")).groupBy(*key, "p.item_slots")
              .agg(F.min("p.slots").alias("low"), F.max("p.slots").alias("high")).where("low <> high")
              .groupBy(*key).agg(F.collect_set("item_slots").alias("broken")))
    sound = met.join(broken, key, "left").where(
        F.col("broken").isNull() | ~F.arrays_overlap(F.col("paired.item_slots"), F.col("broken")))
    own = F.forall("paired", lambda p: p["item_slots"] == p["slots"])
    held = sound.groupBy(*key, "doc_id", "item_id", "total").agg(
        F.count_distinct("item_position").alias("windows"), F.min(own).alias("exact"),
        F.count_distinct(F.when(own, F.col("item_position"))).alias("same"))
    enough = held.where((F.col("windows") >= F.ceil(F.col("total") * F.lit(COVER))) | (F.col("same") >= RUN))
    best = F.max_by(F.struct("windows", F.col("total").alias("item_windows"), "exact"),
                    F.struct(F.col("windows") / F.col("total"), "exact", "windows"))
    return (enough.groupBy("doc", "item", "doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", "b.windows", "b.item_windows", "b.exact"))


def _empty(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    ids = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    return docs.sparkSession.createDataFrame([], f"{ids}, windows long, item_windows long, exact boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; columns unchanged."""
    found = store(matches(docs, benchmark).select("doc_id").distinct(), "contaminated")
    kept = with_ids(docs.select(F.struct("*").alias("whole"), "doc_id"), found, "left_anti")
    return kept.select("whole.*")
