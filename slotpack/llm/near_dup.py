"""Near-duplicate documents by order MinHash, verified by banded alignment.

Words are runs of letters and digits, ASCII case folded. Documents with the same word sequence form
one class. For each class representative, runs of SHINGLE words are labelled with how often they
occurred before in the text; each of SKETCHES hash functions samples the CHOSEN smallest of them and
keeps these in text order, so equal sketches speak for small edit distance and not only for a common
vocabulary. Texts of fewer than FEW words also give the single smallest shingle of each hash function, as
two are too rarely both left whole there. Texts of at most SHORT words give the hashes of what is left
after deleting as many words as SIMILARITY allows edits: two of them that are similar always have one in
common. Equal values put representatives into one bucket.

Number and size follow from the recall at similarity 0.8: scattered edits leave 0.8^3 of the shingles
(Jaccard 0.34, so 1 - (1 - 0.34^2)^64 > 0.999 of the pairs meet), edits of every fifth word, the worst
case, leave two in five (Jaccard 0.25, 0.98 of the pairs).

Members of a bucket are first paired with its first member, which joins large groups of copies. Of what
is then left in several components, all pairs across components are compared in buckets of at most EXACT
rows, inside one task and without emitting them; every member of every component takes part. A larger bucket
with no more pairs across components than one of EXACT rows can have (one large component and a few others,
say) is compared in full too, block by block. Other larger buckets are subdivided by a further sketch, the
smallest words of a few of the SIGNED hash functions, over several tables, so that a similar pair meets
again with probability 0.99 or more in each step (TABLES); what is still larger after the last step is
compared in full in blocks.

In buckets that are compared in full, the rows that pass the sieve with some other row meet once more with
their words, in blocks of LINKED rows, and only similar pairs leave the task: rows of buckets move, not pairs. Pairs
from subdivided buckets (over EXACT rows) and first pairs are moved to their texts instead.

Pairs pass a sieve before any text moves: similar texts share at least two thirds of their words counted
with repetition (Jaccard), so at least 42 of SIGNED smallest words are equal on average; AGREEING is
nearly three standard deviations below that, so 0.998 of the pairs pass even at the threshold. The others are verified: 1 - word edit distance / longer length must
be at least SIMILARITY, computed by alignment inside a diagonal band. Verified pairs form the links, and
linked classes one group (alternating large-star and small-star rounds).

Hot buckets are joined by the skew-safe lookup, and the text of a representative with very many partners
is copied once per PAIRS_PER_COPY of them. Only the words of texts in some sieved pair are moved.

Defined results: null text counts as empty; texts without words are equal only when identical;
texts shorter than SHINGLE words are one shingle; null ids come after all others; repeated rows are
members of one class; texts may be of any length and are never cut; other columns are not read (``keep_one``
returns them unchanged); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotpack.llm.alignment import similar
from slotpack.llm.common import lookup, map_batches, store, with_ids
from slotpack.llm.components import components
from slotpack.llm.words import NOT_ALNUM, _mix, _powers, text_pieces, word_hashes

SHINGLE = 3
SIMILARITY = 0.8
SKETCHES = 64
CHOSEN = 2
#: Texts below FEW words are also sketched by single shingles, those of up to SHORT words by deletions.
FEW = 64
SHORT = 14
PAIRS_PER_COPY = 64
#: Rows of a bucket that one task holds and compares at once, some 130 bytes each.
EXACT = 4096
#: Rows of a bucket that one task compares with their words, so many at most in a pair of blocks.
LINKED = 512
#: Columns of a bucket's row that tell which pairs to compare.
MEMBER = ("node", "words", "root", "sign", "own")
#: Smallest-word hashes of a text, one byte of each is kept; equal ones that a pair needs.
SIGNED = 64
AGREEING = 32
#: Steps of subdivision: (smallest words in a key, tables). A similar pair has 2/3 of them equal at least,
#: so it shares a key with probability 1 - (1 - (2/3)^words)^tables >= 0.99.
TABLES = ((2, 10), (4, 24), (8, 120))
_SIGN = _mix(np.arange(1, SIGNED + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_SEEDS = _mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, NOT_ALNUM)


def sequence_keys(hashes: np.ndarray, bounds: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Two 64-bit hashes (rows) of each text's word sequence; of the raw text where it has no word."""
    n = len(bounds) - 1
    keys, count = np.zeros((2, n), np.uint64), np.diff(bounds)
    full = np.flatnonzero(count)
    if len(full):
        within = np.arange(len(hashes)) - np.repeat(bounds[:-1], count)
        power = _powers(int(count.max()) + 1)[within]
        with np.errstate(over="ignore"):
            for k in range(2):
                lane = _mix(hashes + np.uint64(k * 0x632BE59BD9B4E019)) * power
                keys[k, full] = _mix(np.add.reduceat(lane, bounds[:-1][full]) + count[full].astype(np.uint64))
    for i in np.flatnonzero(count == 0):
        raw = hashlib.md5(b"\0" + (texts[i] or "").encode("utf-8", "surrogatepass")).digest()
        keys[:, i] = np.frombuffer(raw, np.uint64)
    return keys


def _shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labelled shingles in text order, bounds): equal runs of words differ by their occurrence number."""
    count = np.diff(bounds)
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
        run = np.zeros(len(hashes), np.uint64)
        for j in range(SHINGLE):
            inside = np.arange(len(hashes)) + j < np.repeat(bounds[1:], count)
            run = run * np.uint64(0xD1342543DE82EF95) + np.where(inside, padded[j:j + len(hashes)], np.uint64(j))
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    own = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(own[-1]) - np.repeat(own[:-1], shingles) + np.repeat(bounds[:-1], shingles)
    return _labelled(_mix(run[at]), own), own


def _labelled(run: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hash of each value and its occurrence number in its text; ``own`` are the bounds of the texts."""
    owner = np.repeat(np.arange(len(own) - 1), np.diff(own))
    with np.errstate(over="ignore"):
        key = _mix(run + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        seen = np.zeros(len(key), np.uint64)
        seen[order] = (np.arange(len(key)) - start).astype(np.uint64)
        return _mix(run + seen * np.uint64(0xA0761D6478BD642F))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One byte of the smallest labelled word under each of SIGNED hash functions (zeros without words)."""
    out = np.zeros((len(bounds) - 1, SIGNED), np.uint8)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        labelled, first = _labelled(hashes, bounds), bounds[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(SIGNED):
                value = labelled * _SIGN[k]
                value ^= value >> np.uint64(29)
                out[full, k] = _mix(np.minimum.reduceat(value, first)) & np.uint64(255)
    return out


def _first_smallest(value: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Index of the first smallest value of each run."""
    least = np.minimum.reduceat(value, first)
    at = np.flatnonzero(value == np.repeat(least, sizes))
    owner = np.searchsorted(first, at, side="right") - 1
    found = np.zeros(len(first), np.int64)
    found[owner[::-1]] = at[::-1]
    return found


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 * SKETCHES values for each text that has words (rows of other texts are 0).

    First the order-MinHash values of CHOSEN shingles, then those of the smallest shingle alone.
    """
    labelled, own = _shingles(hashes, bounds)
    out = np.zeros((len(bounds) - 1, 2 * SKETCHES), np.uint64)
    sizes = np.diff(own)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first, sizes = own[:-1][full], sizes[full]
    highest = np.uint64(2**64 - 1)
    with np.errstate(over="ignore"):
        for k in range(SKETCHES):
            value = labelled * (_SEEDS[0, k] | np.uint64(1)) + _SEEDS[1, k]
            value ^= value >> np.uint64(31)
            chosen = []
            for _ in range(CHOSEN):
                chosen.append(_first_smallest(value, first, sizes))
                value[chosen[-1]] = highest
            places = np.sort(np.stack(chosen), axis=0)  # text order; a text of one shingle chooses it again
            mixed = np.full(len(full), np.uint64(k + 1))
            for p in places:
                mixed = _mix(mixed * np.uint64(0xD1342543DE82EF95) + labelled[p])
            out[full, k] = mixed
            out[full, SKETCHES + k] = _mix(labelled[chosen[0]] + np.uint64(SKETCHES + k + 1) * np.uint64(0x9E3779B97F4A7C15))
    return out


def deletion_keys(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the rows (texts of one length) after each deletion of at most the allowed number of words."""
    n = hashes.shape[1]
    keys = []
    with np.errstate(over="ignore"):
        for k in range(int((1 - SIMILARITY) * n + 1e-9) + 1):
            power = _powers(n - k + 1)[:n - k]
            for gone in combinations(range(n), k):
                left = np.delete(hashes, gone, axis=1)
                keys.append(_mix((_mix(left) * power).sum(axis=1, dtype=np.uint64) + np.uint64(n - k)))
    return np.stack(keys, axis=1)


def bucket_values(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The values of each text that put it into buckets; any two similar texts use a kind in common."""
    out, count = [np.zeros(0, np.uint64)] * (len(bounds) - 1), np.diff(bounds)
    every = sketches(hashes, bounds)
    for i in np.flatnonzero(count > SIMILARITY * SHORT):
        begin = 0 if count[i] >= SIMILARITY * FEW else SKETCHES
        out[i] = every[i, begin:2 * SKETCHES if count[i] < FEW else SKETCHES]
    for n in range(1, SHORT + 1):
        own = np.flatnonzero(count == n)
        if len(own):
            keys = deletion_keys(hashes[bounds[own][:, None] + np.arange(n)])
            for i, k in zip(own, keys, strict=True):
                out[i] = np.unique(np.concatenate([k, out[i]]))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketched(docs: DataFrame) -> DataFrame:
    """Stored (row, doc_id, high, low, words, sketch, sign): one pass over the whole texts, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, part in text_pieces(b.column("text")):
                hashes, bounds = _words(part)
                keys = sequence_keys(hashes, bounds, part)
                values = bucket_values(hashes, bounds)
                ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(values)))
                sign = pa.array([x.tobytes() for x in signatures(hashes, bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").slice(begin, len(part)), b.column("doc_id").slice(begin, len(part)),
                     _signed(keys[0]), _signed(keys[1]), pa.array(np.diff(bounds)), sketch, sign],
                    ["row", "doc_id", "high", "low", "words", "sketch", "sign"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"row long, doc_id {kind}, high long, low long, words long, sketch array<long>, sign binary"
    return store(map_batches(rows, run, schema), "sketched")


def classes(rows: DataFrame) -> DataFrame:
    """Stored (high, low, node, first, members): documents of one word sequence; node names the class."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    found = rows.groupBy("high", "low").agg(first.alias("f"), F.count(F.lit(1)).alias("members"))
    return store(found.select("high", "low", F.col("f.row").alias("node"), F.col("f.doc_id").alias("first"),
                              "members"), "classes")


def bucket_members(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Stored (bucket, node, words, members) of all buckets with more than one class."""
    singles = found.select("node", F.col("node").alias("row"))
    banded = store(rows.where("words > 0").join(singles, "row")
                   .select("node", "words", F.explode("sketch").alias("bucket")), "banded")
    buckets = store(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"),
                                                 F.min(F.struct("node", "words")).alias("one"))
                    .where("members > 1"), "buckets")
    return store(lookup(banded, buckets, ["bucket"], size="members"), "met")


def _lengths_allow(a: str, b: str) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(SIMILARITY) - F.lit(1e-9)


def first_pairs(met: DataFrame, signs: DataFrame) -> DataFrame:
    """Stored distinct (one, two) that pass the sieve: each member of a bucket with the bucket's first member."""
    near = met.where((F.col("node") != F.col("one.node")) & _lengths_allow("words", "one.words"))
    return sieved(near.select(F.col("one.node").alias("one"), F.col("node").alias("two")).distinct(), signs)


def sieved(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Stored pairs whose signatures agree in AGREEING places; a node with very many partners is spread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, SIGNED) for x in ("left", "right"))
            yield b.select(["one", "two"]).filter(pa.array((a == c).sum(1) >= AGREEING))

    pairs = store(pairs, "pairs")
    degree = pairs.groupBy("one").agg(F.count(F.lit(1)).alias("partners"))
    named = store(degree.join(signs.withColumnRenamed("node", "one"), "one").withColumnRenamed("sign", "left"), "degree")
    dealt = lookup(pairs, named, ["one"], size="partners").drop("partners")
    both = dealt.join(signs.withColumnRenamed("node", "two").withColumnRenamed("sign", "right"), "two")
    return store(map_batches(both.select("one", "two", "left", "right"), run, "one long, two long"), "sieved")


def _open(members: DataFrame, key: str) -> DataFrame:
    """(key, n, top, cross) of the keys with several components: rows, the largest component and pairs across components."""
    per = members.groupBy(key, "root").agg(F.count(F.lit(1)).alias("members"))
    sizes = per.groupBy(key).agg(F.sum("members").alias("n"), F.max(F.struct("members", "root")).alias("top"),
                                 F.sum(F.col("members") * F.col("members")).alias("_same"), F.count(F.lit(1)).alias("_roots"))
    return sizes.where("_roots > 1").select(key, "n", "top", F.expr("(n * n - _same) div 2").alias("cross"))


def open_members(placed: DataFrame) -> DataFrame | None:
    """Stored (key, node, words, root, n, top, cross): all rows of the buckets with several components; None without any."""
    opened = store(_open(placed, "bucket"), "open")
    if opened.isEmpty():
        return None
    rows = lookup(placed, opened, ["bucket"], size="n")
    return store(rows.select(F.col("bucket").alias("key"), "node", "words", "root", "n", "top", "cross"), "rows")


def subdivided(rows: DataFrame, step: int, words: int, tables: int) -> DataFrame:
    """Stored rows of the same shape under finer keys: ``words`` places of the signature, in ``tables`` ways."""
    places = np.random.default_rng(step).permuted(np.tile(np.arange(SIGNED), (tables, 1)), axis=1)[:, :words] + 1
    chosen = [F.xxhash64("key", F.lit(t), *[F.substring("sign", int(k), 1) for k in p]) for t, p in enumerate(places)]
    none = F.lit(None).cast("array<bigint>")  # a pair may share keys here that it does not share there
    fine = store(rows.withColumn("key", F.explode(F.array(*chosen))).withColumn("own", none).drop("n", "top", "cross"), "fine")
    sizes = store(_open(fine, "key"), "sizes")
    return store(lookup(fine, sizes, ["key"], size="n").select(*rows.columns), "rows")


def in_blocks(rows: DataFrame, half: int) -> DataFrame:
    """Rows of keys of any size, once for each pair of blocks (low, high) that they take part in.

    A block holds about ``half`` rows. The largest component of a key has blocks of its own, which meet
    the blocks of the other rows only.
    """
    place = F.xxhash64("node", "key")
    largest, other = F.ceil(F.col("top.members") / half), F.ceil((F.col("n") - F.col("top.members")) / half)
    big = F.col("root") == F.col("top.root")
    block = F.when(big, other + F.pmod(place, largest)).otherwise(F.pmod(place, other))
    met = F.when(big, other).otherwise(other + largest)
    dealt = rows.withColumn("block", block).withColumn("_met", F.explode(F.sequence(F.lit(0).cast("bigint"), met - 1)))
    return dealt.withColumn("low", F.least("block", "_met")).withColumn("high", F.greatest("block", "_met")).drop("_met")


def each_group(rows: DataFrame, of_group: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``of_group`` yields for the rows of each key, or of each pair of its blocks (``in_blocks``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            part = pa.Table.from_batches([b])
            held = part if kept is None else pa.concat_tables([kept, part]).combine_chunks()
            group = np.stack([held[c].to_numpy() for c in ("key", "low", "high")])
            starts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                yield from of_group(held.slice(begin, end - begin))
            kept = held.slice(starts[-1])
        if kept is not None:
            yield from of_group(kept)

    if "block" not in rows.columns:
        rows = rows.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("block", "low", "high")])
    group = ["key", "low", "high"]
    more = [c for c in rows.columns if c == "sequence"]
    dealt = rows.select(*group, *MEMBER, "block", *more).repartition(*group).sortWithinPartitions(*group)
    return map_batches(dealt, run, schema)


def compared(rows: DataFrame) -> DataFrame:
    """(one, two) across components that pass the sieve: all pairs of a key, or of a pair of its blocks (``in_blocks``).

    Where rows carry all keys of their node (``own``), a pair comes from the least key it shares only.
    """
    return each_group(rows, _pairs_of, "one long, two long")


def _sieved_in(members: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the rows before it that are of another component and pass the sieve, if any."""
    root, words, block = (members[c].to_numpy() for c in ("root", "words", "block"))
    within = members["low"][0] == members["high"][0]
    sign = np.frombuffer(b"".join(members["sign"].to_pylist()), np.uint8).reshape(-1, SIGNED)
    key, own = members["key"][0].as_py(), [None if x is None else frozenset(x) for x in members["own"].to_pylist()]
    for i in range(1, len(root)):
        fits = (root[:i] != root[i]) & (np.minimum(words[:i], words[i]) >= np.maximum(words[:i], words[i]) * SIMILARITY - 1e-9)
        at = np.flatnonzero(fits if within else fits & (block[:i] != block[i]))
        at = at[(sign[at] == sign[i]).sum(1) >= AGREEING]
        if own[i] is not None:
            at = np.array([j for j in at.tolist() if min(own[i] & own[j]) == key], np.int64)
        if len(at):
            yield i, at


def _ordered(node: np.ndarray, i: int, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[at], node[i])), pa.array(np.maximum(node[at], node[i]))], ["one", "two"])


def _pairs_of(members: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that pass the sieve."""
    node = members["node"].to_numpy()
    for i, at in _sieved_in(members):
        yield _ordered(node, i, at)


def _partnered_of(members: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that pass the sieve with some other row: at most one of each row, however many pairs they make."""
    some = np.zeros(len(members), bool)
    for i, at in _sieved_in(members):
        some[at] = some[i] = True
    if some.any():
        yield from members.select(["key", *MEMBER]).filter(pa.array(some)).to_batches()


def _links_of(members: pa.Table) -> Iterator[pa.RecordBatch]:
    """Similar pairs of different components: those that pass the sieve and have enough words in common are aligned."""
    node, words = members["node"].to_numpy(), members["words"].to_numpy()
    sequences = [np.frombuffer(x.as_buffer(), np.uint32) for x in members["sequence"]]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
    kinds, each = np.unique(_labelled(np.concatenate(sequences).astype(np.uint64), bounds), return_inverse=True)
    for i, at in _sieved_in(members):
        has = np.zeros(len(kinds), bool)
        has[each[bounds[i]:bounds[i + 1]]] = True
        common = np.add.reduceat(has[each[:bounds[i]]], bounds[:i], dtype=np.int64)[at]
        longer = np.maximum(words[at], words[i])
        at = at[longer - common <= ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)]
        at = np.array([j for j in at.tolist() if similar(sequences[j], sequences[i], SIMILARITY)], np.int64)
        if len(at):
            yield _ordered(node, i, at)


def signed_rows(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """Stored rows of open buckets with their signature, their bucket and all such buckets of their node (``own``)."""
    own = rows.groupBy("node").agg(F.collect_list("key").alias("own"))
    return store(rows.join(own, "node").join(signs, "node").withColumn("bucket", F.col("key")), "signed")


def _in_full() -> Column:
    """Whether a key has no more pairs across components than one of EXACT rows can have."""
    return (F.col("n") <= EXACT) | (F.col("cross") <= EXACT * EXACT // 2)


def _dealt(rows: DataFrame, most: int) -> list[DataFrame]:
    """The rows of keys of at most ``most`` rows as they are, those of larger ones by pairs of blocks."""
    return [rows.where(F.col("n") <= most), in_blocks(rows.where(F.col("n") > most), max(most // 2, 1))]


def bucket_links(rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Stored distinct (one, two) of similar members in the keys that are compared in full; None without any candidate.

    The rows that pass the sieve with some other row meet again with their words, and are compared there in blocks
    of LINKED rows: what moves are rows of keys, never their pairs.
    """
    kinds = rows.select("key", *MEMBER).schema
    met = reduce(DataFrame.unionByName, [each_group(g, _partnered_of, kinds) for g in _dealt(rows.where(_in_full()), EXACT)])
    met = store(met.dropDuplicates(["key", "node"]), "partnered")
    if met.isEmpty():
        return None
    sequences = word_sequences(docs, nodes, met.select("node").distinct())
    sized = store(lookup(met, store(_open(met, "key"), "sizes"), ["key"], size="n"), "sized")
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _dealt(sized, LINKED)).fillna(0, ["block", "low", "high"])
    return store(each_group(dealt.join(sequences, "node"), _links_of, "one long, two long").distinct(), "found")


def finer_pairs(rows: DataFrame) -> list[DataFrame]:
    """Pairs (one, two) that pass the sieve in the subdivisions of the keys that are not compared in full."""
    found = []
    for step, (words, tables) in enumerate(TABLES):
        large = rows.where(~_in_full())
        if large.isEmpty():
            return found
        rows = subdivided(large, step, words, tables)
        if step < len(TABLES) - 1:
            found += map(compared, _dealt(rows.where(_in_full()), EXACT))
    # what no key makes smaller is compared once in its first bucket, not under each of its keys
    found.append(compared(rows.where(F.col("n") <= EXACT)))
    left = rows.where(F.col("n") > EXACT).withColumn("key", F.col("bucket")).drop("n", "top", "cross")
    left = store(left.dropDuplicates(["key", "node"]), "left")
    found.append(compared(in_blocks(lookup(left, store(_open(left, "key"), "sizes"), ["key"], size="n"), max(EXACT // 2, 1))))
    return found


def untried(found: list[DataFrame], tried: DataFrame) -> DataFrame:
    """Stored distinct (one, two) that were not yet tried."""
    pairs = store(reduce(DataFrame.unionByName, found).distinct(), "found")
    return store(pairs.join(tried.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")),
                            ["one", "two"], "left_anti"), "pairs")


def further_pairs(rows: DataFrame, signs: DataFrame, tried: DataFrame) -> DataFrame:
    """Stored distinct (one, two) of open buckets that pass the sieve and were not yet tried."""
    rows = signed_rows(rows, signs)
    return untried([*map(compared, _dealt(rows.where(_in_full()), EXACT)), *finer_pairs(rows)], tried)


def further_links(rows: DataFrame, docs: DataFrame, nodes: DataFrame, tried: DataFrame) -> DataFrame | None:
    """Distinct (one, two) of similar members of open buckets; None without any candidate."""
    rows = signed_rows(rows, nodes.select("node", "sign"))
    links, finer = bucket_links(rows, docs, nodes), finer_pairs(rows)
    if not finer:
        return links
    pairs = untried(finer, tried)
    more = verified(pairs, word_sequences(docs, nodes, _ends(pairs)))
    return more if links is None else links.unionByName(more).distinct()


def all_links(docs: DataFrame, met: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (one, two) and components (node, root) of the members ``met`` of all buckets."""
    signs = nodes.select("node", "sign")
    tried = first_pairs(met, signs)
    links = verified(tried, word_sequences(docs, nodes, _ends(tried)))
    roots = store(components(links), "roots")
    placed = store(met.select("bucket", "node", "words").join(roots, "node", "left")
                   .withColumn("root", F.coalesce("root", "node")), "placed")
    rows = open_members(placed)
    more = None if rows is None else further_links(rows, docs, nodes, tried)
    if more is None or more.isEmpty():
        return links, roots
    return links.unionByName(more), joined(roots, more)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (node, root) after further ``links``, which are contracted to the components known so far."""
    known = links.join(roots.withColumnRenamed("node", "one").withColumnRenamed("root", "a"), "one", "left").join(
        roots.withColumnRenamed("node", "two").withColumnRenamed("root", "b"), "two", "left")
    between = store(known.select(F.coalesce("a", "one").alias("one"), F.coalesce("b", "two").alias("two")).distinct(), "between")
    new = store(components(between), "merged")
    alone = new.join(roots.select("node"), "node", "left_anti")
    renamed = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = lookup(roots, renamed, ["root"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return store(old.unionByName(alone), "roots")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("one").alias("node")).unionByName(pairs.select(F.col("two").alias("node"))).distinct()


def word_sequences(docs: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Stored (node, sequence): word hashes (32 bits each) of the classes in ``used``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in text_pieces(b.column("text")):
                hashes, bounds = _words(part)
                keys = sequence_keys(hashes, bounds, part)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                own = [short[bounds[i]:bounds[i + 1]].tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([_signed(keys[0]), _signed(keys[1]), pa.array(own, pa.binary())],
                                                 ["high", "low", "sequence"])

    nodes = store(nodes.join(used, "node").select("node", "first", "high", "low"), "used")
    texts = with_ids(docs.select("doc_id", "text"), nodes.select(F.col("first").alias("doc_id")).distinct(), "left_semi")
    own = map_batches(texts.select("text"), run, "high long, low long, sequence binary")
    return store(own.dropDuplicates(["high", "low"]).join(nodes.select("high", "low", "node"), ["high", "low"])
                 .select("node", "sequence"), "sequences")


def verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Stored (one, two): the pairs whose word sequences are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), SIMILARITY)
                    for x, y in zip(b.column("left"), b.column("right"), strict=True)]
            yield b.select(["one", "two"]).filter(pa.array(good, pa.bool_()))

    degree = store(pairs.groupBy("one").agg(F.count(F.lit(1)).alias("partners")), "degree")
    copies = F.ceil(F.col("partners") / F.lit(PAIRS_PER_COPY)).cast("int")
    dealt = (lookup(pairs, degree, ["one"], size="partners")
             .withColumn("salt", F.pmod(F.xxhash64("two"), copies).cast("int")))
    left = (sequences.join(degree.withColumnRenamed("one", "node"), "node")
            .select(F.col("node").alias("one"), F.col("sequence").alias("left"),
                    F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")))
    right = sequences.select(F.col("node").alias("two"), F.col("sequence").alias("right"))
    both = dealt.join(right, "two").join(left, ["one", "salt"]).select("one", "two", "left", "right")
    return store(map_batches(both, run, "one long, two long"), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """Per document: row, doc_id, class_id (smallest doc_id of its group), links, kept.

    ``links`` counts the verified pairs of the document's class; one row of each group is ``kept``,
    that of the smallest doc_id.
    """
    rows = sketched(docs)
    found = classes(rows)
    met = bucket_members(rows, found)
    signs = rows.select(F.col("row").alias("node"), "sign")
    nodes = store(found.join(met.select("node").distinct(), "node").join(signs, "node"), "nodes")
    links, roots = all_links(docs, met, nodes)
    pairs = links.select(F.greatest("one", "two").alias("one"), F.least("one", "two").alias("two")).distinct()
    ends = pairs.select(F.col("one").alias("node")).unionByName(pairs.select(F.col("two").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    placed = store(found.join(roots, "node", "left").join(degree, "node", "left").select(
        "high", "low", "members", "first", "node", F.coalesce("root", "node").alias("root"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("links")), "placed")
    groups = store(placed.groupBy("root").agg(
        F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "node")).alias("head"),
        F.count(F.lit(1)).alias("classes")), "groups")
    headed = store(lookup(placed, groups, ["root"], size="classes").select(
        "high", "low", "members", "links", F.col("head.first").alias("class_id"), F.col("head.node").alias("head_row")),
        "headed")
    return lookup(rows.drop("sketch", "words", "sign"), headed, ["high", "low"], size="members").select(
        "row", "doc_id", "class_id", "links", (F.col("row") == F.col("head_row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group; columns unchanged.

    Dropped rows are told by their doc_id. Where a dropped and a kept row share a doc_id (repeated
    ids), rows are told by their place in the scan instead, which is the same for one stored table.
    """
    out = store(near_groups(docs), "near")
    lost = store(out.where(~F.col("kept")).select("doc_id").distinct(), "lost")
    rows = docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row"), "doc_id")
    if with_ids(out.where("kept"), lost, "left_semi").isEmpty():
        return with_ids(rows, lost, "left_anti").select("whole.*")
    gone = out.where(~F.col("kept")).select(F.col("row").alias("gone_row"))
    return rows.join(gone, F.col("row") == F.col("gone_row"), "left_anti").select("whole.*")
