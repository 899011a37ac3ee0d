from slotpack.llm import bpe_count
from slotpack.llm.common import vocabulary

ODD = ["", "a", "x<|endoftext|>y <|startoftext|><|endoftext|> It's THE'RE", "ΑΣ ΣΑΣ Σ", "é é café", "１２３ ²³ ½",
       "a\x1cb\x85c", "İstanbul ǅ ß ẞ", "🙂🙂 a🙂b", "日本語", "___a_b__", "\x00\x01", "don’t", "'S 'LL", "नमस्ते", "<|ENDOFTEXT|>"]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), bpe_count.counter(path)
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [own.count(t) for t in texts] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_count, "MOST_WORDS", 3)
    own = bpe_count.MergeCounter(vocabulary("word_bpe_49k.json"))
    assert [own.count(t) for t in ["one two three four five", "six", "one two"]] == [5, 1, 2]
    assert len(own._known) <= 8


def test_edge_rows(frame, edge_rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = bpe_count.token_counts(frame(edge_rows), vocabulary("word_bpe_49k.json")).collect()
    expected = [(i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in edge_rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert bpe_count.token_counts(frame([]), vocabulary("word_bpe_49k.json")).collect() == []
