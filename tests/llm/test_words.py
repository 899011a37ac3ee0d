import re

import numpy as np

from slotpack.llm import fuse, words

TEXTS = ["", None, "a", " a  bb\tA\n", "x" * 5000 + " y", "Ünï 日本", "\x1c a\x85b\x0bc"]


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_match_a_split_by_ascii_white_space():
    hashes, bounds = words.word_hashes(TEXTS)
    expected = [[w for w in re.split(r"[\x20\x09-\x0D]+", _lower(t)) if w] for t in TEXTS]
    assert np.diff(bounds).tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    by_hash = {}
    for h, w in zip(hashes.tolist(), flat, strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(flat))


def test_stems_are_shared_by_words_with_the_same_first_bytes():
    stems, _ = words.stem_hashes(["abcdefg abcdexx abcde abc"], (5,))
    assert stems[1, 0] == stems[1, 1] != stems[1, 2]
    assert stems[1, 2] == stems[0, 2] and stems[1, 3] == stems[0, 3]


def test_endings():
    _, ending, _ = words.words_and_endings(["walking king g"])
    assert ending[0] == ending[1] != ending[2]


def test_pieces_cover_all_texts_once():
    texts = ["x" * 700_000, "", None, "y" * 400_000, "z"]
    cut = list(words.pieces(texts))
    assert cut[0][0] == 0 and cut[-1][1] == len(texts)
    assert all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    assert list(words.pieces([])) == []


def test_fuse_filter_accepts_members_and_few_others():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 300, 40_000):
        keys = rng.integers(-2**63, 2**63 - 1, n)
        data = fuse.build(keys)
        assert fuse.probe(data, keys).all()
        assert fuse.probe(data, rng.integers(-2**63, 2**63 - 1, 100_000)).mean() < 0.001
    assert fuse.probe(fuse.build(np.array([5, 5, 5])), np.array([5, 6])).tolist()[0]
