"""Token ids of whole texts under a byte-level BPE vocabulary file of the ``tokenizers`` library.

Ordinary texts are encoded by tiktoken with the ranks of the same file, which gives the same ids
several times faster; texts with a special string or with characters whose class may differ between
the two libraries' regular expressions go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Split pattern of the byte-level pre-tokenizer (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: ASCII without rare controls, Latin letters, general punctuation: classes that all engines share.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¿À-ɏ‐-‧]*")
_OPEN: dict[str, ByteTokens] = {}


def byte_chars() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Encoder for one vocabulary file; ``sentence_end[id]`` tells tokens that close a sentence or line."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self._path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec["added_tokens"]]
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in self._special}
        self._fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sentence_end = np.zeros(max(max(vocab.values()), *ranks.values()) + 1, bool)
        for t, i in ranks.items():
            self.sentence_end[i] = t.rstrip(b" \"')").endswith((b".", b"!", b"?", b"\n"))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, as ``tokenizers`` gives them without added special tokens."""
        if not text:
            return np.zeros(0, np.uint32)
        if _PLAIN.fullmatch(text) and not any(s in text for s in self._special):
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        if self._whole is None:  # opened for the first text that needs it
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)


def tokens(path: str) -> ByteTokens:
    """The encoder of a file, opened once per Python process."""
    if path not in _OPEN:
        _OPEN[path] = ByteTokens(path)
    return _OPEN[path]
