import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
        if not extra:
            return df
        names = ["row", "whole", "digest", "label", "block", "bucket", "node", "token", "score", "own_id", "kept_id",
                 "size", "high", "low", "v", "x"]
        return df.select("*", *[F.lit(7).alias(n) for n in names])
    return make


@pytest.fixture
def edge_rows():
    """Null and empty texts, null ids, repeated rows, ties, white space, other scripts and a very long text."""
    return [(1, "One plain text with some words, and more of them."), (1, "One plain text with some words, and more of them."),
            (2, None), (3, ""), (4, "   \t\n "), (5, "!!! *** ###"), (6, "Ünï¢ödé 日本語 🙂 text\x1fx  y"), (None, "A text without an id."),
            (None, None), (7, "a"), (8, "a"), (9, "word " * 30000), (10, "<|endoftext|> and <|startoftext|>"),
            (2, "another text under the same id")]
