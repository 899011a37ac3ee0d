import itertools
import random
import zlib

import numpy as np
import pytest

from slotpack.llm import packing
from slotpack.llm.common import vocabulary
from slotpack.llm.tokens import tokens


def _cheapest(at, penalty, window):
    best = {0: 0}
    for j, p in zip(at, penalty, strict=True):
        best[j] = min((c + window - (j - i) + p for i, c in best.items() if j - i <= window), default=None)
    return best[at[-1]]


def test_cuts_are_the_cheapest():
    r = random.Random(4)
    for _ in range(300):
        window = r.randint(3, 12)
        at = list(itertools.accumulate(r.randint(1, window) for _ in range(r.randint(1, 25))))
        penalty = [r.choice([0, 1, 4]) for _ in at]
        cuts = packing.best_cuts(at, penalty, window)
        assert cuts[-1] == at[-1] and all(b - a <= window for a, b in zip([0, *cuts], cuts))
        cost = sum(window - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(penalty[at.index(c)] for c in cuts)
        assert cost == _cheapest(at, penalty, window)


def test_open_end_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(300):
        window = r.randint(3, 12)
        at = list(itertools.accumulate(r.randint(1, window) for _ in range(r.randint(1, 25))))
        penalty = [r.choice([0, 1, 4]) for _ in at]
        cuts = packing.best_cuts(at, penalty, window, open_end=True)
        best = {0: 0}
        for j, p in zip(at, penalty, strict=True):
            best[j] = min(c + window - (j - i) + p for i, c in best.items() if j - i <= window)
        last = cuts[-1] if cuts else 0
        assert at[-1] - last <= window
        cost = sum(window - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(penalty[at.index(c)] for c in cuts)
        assert cost == best[last] == min(c for i, c in best.items() if at[-1] - i <= window)


@pytest.mark.parametrize("many", [1, 700, 2047, 2048, 2049, 2330, 4108, 9000, 14107, 20000])
def test_partitions_of_any_size_pad_little(many):
    r = random.Random(many)
    closing = np.zeros(1000, bool)
    closing[:30] = True
    stream, left, doc = packing.Stream(packing.WINDOW, 0, closing), many, 0
    while left:
        n = min(left, r.choice([1, 20, 300, 5000]))
        stream.add(doc, np.array([r.randint(0, 999) for _ in range(n)], np.uint32))
        left, doc = left - n, doc + 1
    fill = {}
    for piece in stream.take(last=True):
        fill[piece[5]] = piece[6] + piece[2]
    padding = sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in fill.values())
    assert sum(fill.values()) == many and padding <= 0.01 * many


def _check(rows, pieces, window=packing.WINDOW):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected = sorted((str(i), tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    texts = {}
    for i, ids in expected:
        texts.setdefault(i, []).append(np.array(ids, "<u4"))
    total = 0
    for p in pieces:
        found = [t for t in texts[str(p.doc_id)] if len(t) == p.doc_tokens
                 and zlib.crc32(t[p.start:p.start + p.length].tobytes()) == p.ids_crc32]
        assert found and p.length > 0
        total += p.length
    assert total == sum(len(t) for _, t in expected)
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in fill.values()) / total


def test_edge_rows(frame, edge_rows):
    got = packing.pack(frame(edge_rows), vocabulary("byte_bpe_50k.json")).collect()
    _check(edge_rows, got)
    assert packing.pack(frame([]), vocabulary("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("block", [5000, 1 << 20])
def test_little_padding_over_blocks(spark, block, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    monkeypatch.setattr(packing, "BLOCK", block)
    encode, end = tokens(vocabulary("byte_bpe_50k.json")), np.array([1], np.uint32)
    stream, got = packing.Stream(packing.WINDOW, 0, encode.sentence_end), []
    for i, t in rows:
        stream.add(i, np.concatenate([encode.ids(t), end]))
        if stream.size >= block:
            got += stream.take(last=False)
    got += stream.take(last=True)

    class Piece:
        def __init__(self, values):
            (self.doc_id, self.start, self.length, self.ids_crc32, self.doc_tokens, self.sequence_id, self.offset) = values
    assert _check(rows, [Piece(p) for p in got]) < 0.01


def test_fast_ids_equal_the_library(edge_rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), tokens(path)
    for t in [t for _, t in edge_rows if t] + ["it's  I'LL we've\n\n x ", "¼ ² ÿ 12,345.67", "a b c", "\r\n\t "]:
        assert own.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids
