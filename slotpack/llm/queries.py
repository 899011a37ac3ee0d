"""One query per training-data operator, over its whole table, and the DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotpack.llm import (arc_warc, bpe_count, chat, decontam, exact_dedup, hmm, mixing, near_dup, packing, quality,
                          repair, toxicity, whitening)
from slotpack.llm.common import read, remainder, vocabulary

TOKEN_LIMIT = 2048


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` packed into sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    out = bpe_count.token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document of ``documents``; one row of each group is kept."""
    return near_dup.near_groups(read(spark, sf_dir, "documents")).drop("row")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of ``documents``: which row stays, group size and digest of the normalised text."""
    out = exact_dedup.exact_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and significant passages of every whole text of ``documents``."""
    out = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(toxicity.SPLIT_MODULUS) == toxicity.HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "passages")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as read back from WARC files that were converted from ARC files."""
    return arc_warc.page_records(read(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations of ``conversations``, rendered in parts of 256 turns."""
    return chat.formatted(read(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item found in a document of ``documents``, with the number of shared windows."""
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    out = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(quality.SPLIT_MODULUS) == quality.HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text of ``documents`` under the hidden Markov model and its base."""
    out = hmm.language_scores(read(spark, sf_dir, "documents"))
    return out.withColumn("held_out", remainder(hmm.SPLIT_MODULUS) == hmm.HELD_OUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every usable row of ``embeddings``."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation of the damaged ``conversations``."""
    return repair.repaired(read(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of ``documents``."""
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_chat_format": op7_chat_format,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_hmm_score": op10_hmm_score,
    "op11_whitening": op11_whitening,
    "op12_repair": op12_repair,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
                   FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op6_arc_to_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             k AS (SELECT html, max(page_id) AS kept, sha1(html) AS hex FROM p GROUP BY html),
             d AS (SELECT html, kept, array_to_string(flatten(list_transform(range(0, 8), lambda i: list_transform(
                       [15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) >> b) & 31) + 1, 1)))), '') AS payload_digest
                   FROM k)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM p JOIN d USING (html)""",
    "op7_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '') AS role,
                          coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
             p AS (SELECT conv_id, row_number() OVER w - 1 AS position, role, text,
                          string_agg(role || chr(31) || text || chr(30), '') OVER w AS prefix
                   FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
             c AS (SELECT conv_id, max(position) + 1 AS n_turns, arg_max(prefix, position) AS whole
                   FROM p GROUP BY conv_id),
             g AS (SELECT whole, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY whole, n_turns),
             q AS (SELECT DISTINCT prefix FROM p JOIN c USING (conv_id) WHERE position + 1 < n_turns)
        SELECT conv_id, CAST(floor(position / 256) AS BIGINT) AS part, n_turns, copies,
               string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY position) AS rendered
        FROM p JOIN g USING (conv_id) WHERE whole NOT IN (SELECT prefix FROM q)
        GROUP BY conv_id, CAST(floor(position / 256) AS BIGINT), n_turns, copies""",
    "op12_repair": r"""
        WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                          string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k
                   FROM conversations),
             c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda x: CAST(ascii(x) AS BIGINT))),
                          lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)),
                                                   lambda v, j: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS code FROM s),
             d AS (SELECT conv_id, turn, sha256(role || chr(31) || text) AS tie, copy,
                          CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                          CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                   FROM c, (VALUES (0), (1)) x(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
             r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS i,
                          regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
             f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS ini, last = '' AS blank, last <> '' AND
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, last FROM r),
             g AS MATERIALIZED (SELECT *, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS cut, blank OR again AS doomed,
                          lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
             ins(q, q2, n, lines) AS (VALUES (0, 0, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []),
                          (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (2, 2, 0, []), (2, 3, 1, ['assistant:']),
                          (2, 2, 2, ['assistant:', 'user:']), (3, 3, 0, []), (3, 2, 1, ['user:']), (3, 3, 2, ['user:', 'assistant:'])),
             op(q, ini, q2, e, price, role) AS (VALUES (0, NULL, 0, 'D', 3, NULL), (1, NULL, 1, 'D', 3, NULL), (2, NULL, 2, 'D', 3, NULL),
                          (3, NULL, 3, 'D', 3, NULL), (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL),
                          (2, 'a', 3, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL), (0, NULL, 2, 'R', 2, 'user'), (1, NULL, 2, 'R', 2, 'user'),
                          (2, NULL, 3, 'R', 2, 'assistant'), (3, NULL, 2, 'R', 2, 'user')),
             w(conv_id, i, q, v) AS (
                 SELECT DISTINCT conv_id, 0::BIGINT, 0, {'c': 0::BIGINT, 'p': '', 't': []::VARCHAR[]} FROM g UNION ALL
                 SELECT conv_id, i, q, min(v) FROM (
                     SELECT g.conv_id, g.i, op.q2 AS q, {'c': CAST(w.v.c + 2 * ins.n + op.price
                                + CASE WHEN g.cut AND op.e <> 'D' THEN 1 ELSE 0 END AS BIGINT), 'p': w.v.p || repeat('I', ins.n) || op.e,
                            't': w.v.t || CAST(ins.lines AS VARCHAR[]) || CASE WHEN op.e = 'D' THEN []::VARCHAR[]
                                ELSE [coalesce(op.role, g.role) || ':' || g.text] END} AS v
                     FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN ins ON ins.q = w.q
                     JOIN op ON op.q = ins.q2 AND (op.e = 'D' OR NOT g.doomed) AND (op.e <> 'K' OR op.ini = g.ini))
                 GROUP BY conv_id, i, q),
             n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                          count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
                          count(*) FILTER (WHERE cut) AS truncated,
                          count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
             b AS (SELECT w.conv_id, min(CASE w.q WHEN 1 THEN {'c': w.v.c + 4, 'p': w.v.p || 'II', 't': w.v.t || ['user:', 'assistant:']}
                                          WHEN 2 THEN {'c': w.v.c + 2, 'p': w.v.p || 'I', 't': w.v.t || ['assistant:']}
                                          ELSE w.v END) AS v
                   FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i GROUP BY w.conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.v.c, 0) AS BIGINT) AS cost, coalesce(b.v.p, '') AS audit,
               sha256(coalesce(array_to_string(b.v.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
