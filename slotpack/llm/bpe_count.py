"""Token counts of whole texts by byte-pair merging; no token ids are produced.

A word starts as one symbol per byte, the last one marked as the word's end. A heap holds the ranks of
adjacent symbol pairs, a linked list the symbols that are left: the pair of the lowest rank (the
leftmost among equals) is merged until no known pair is left. The word counts its first symbols minus
its merges. Words are cut from the text as the vocabulary file's normaliser and pre-tokenizer say;
counts of words seen before come from a bounded memory of each Python process.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids are counted
like any other row; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from slotpack.llm.tokens import byte_chars

#: Words whose count one process remembers; the memory is emptied when it is full.
MOST_WORDS = 1_000_000
#: Texts of these characters are cut by WORD; others by the library's own normaliser and splitter.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-įĲ-ɏ]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_OPEN: dict[str, MergeCounter] = {}


class MergeCounter:
    """Counts tokens with the merges of one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._normalise, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        chars = byte_chars()
        self._inner = {b: ids[c] for c, b in chars.items()}
        self._last = {b: ids[c + end] for c, b in chars.items()}
        self._chars = chars
        self._pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self._pairs[ids[left], ids[right]] = rank, ids[left + right]
        self._known: dict[str, int] = {}

    def merges(self, symbols: list[int]) -> int:
        """How many merges a word's symbols undergo."""
        pairs, n = self._pairs, len(symbols)
        symbols, after, before = [*symbols, -1], list(range(1, n + 2)), list(range(-1, n))
        heap = [(pairs[p][0], i, *p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in pairs]
        heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if symbols[i] != left or j > n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pairs[left, right][1], -2
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in pairs:
                    heappush(heap, (pairs[p][0], i, *p))
            h = before[i]
            if h >= 0 and (p := (symbols[h], symbols[i])) in pairs:
                heappush(heap, (pairs[p][0], h, *p))
        return done

    def _of_bytes(self, data: bytes) -> int:
        symbols = [self._inner[b] for b in data[:-1]] + [self._last[data[-1]]]
        return len(symbols) - self.merges(symbols)

    def _of_words(self, words: list[str], encode) -> int:
        known = self._known
        if len(known) > MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._of_bytes(encode(w))
        return sum(map(known.__getitem__, words))

    def _of_part(self, part: str) -> int:
        if _PLAIN.fullmatch(part):
            return self._of_words(_WORD.findall(part.lower()), str.encode)
        mapped = [w for w, _ in self._split(self._normalise(part))]
        return sum(self._of_bytes(bytes(map(self._chars.__getitem__, w))) for w in mapped if w)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        if not text:
            return 0
        parts = self._special.split(text)
        return len(parts) - 1 + sum(map(self._of_part, parts))


def counter(path: str) -> MergeCounter:
    """The counter of a file, opened once per Python process."""
    if path not in _OPEN:
        _OPEN[path] = MergeCounter(path)
    return _OPEN[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document; one pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            text = b.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), size, pa.array(map(count, text.to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
