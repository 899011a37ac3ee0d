import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from slotpack.llm import hmm

from .conftest import prose


def _tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def _check_base(rows, got):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(_tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(str((i, len(w), sum(counts[x] > 0 for x in w), n,
                           round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)))
                      for i, t in rows for w in [_tokens(t)])
    assert sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got) == expected


def test_forward_sums_all_paths():
    rng = np.random.default_rng(0)
    n, k = 5, hmm.STATES
    chain = hmm.Chain(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(n), k).T)
    texts = [np.array(x, np.uint16) for x in ([0, 1, 4], [2], [3, 3], [1, 0, 2])]
    lat = hmm.Lattice.of(texts)
    log = np.bincount(lat.owner, np.log(hmm.forward(chain, lat)[1]))
    for i, t in enumerate(texts):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(t)):
            p = chain.initial[path[0]] * chain.emit[t[0], path[0]]
            for a, b, c in zip(path, path[1:], t[1:]):
                p *= chain.step[a, b] * chain.emit[c, b]
            total += p
        assert abs(log[i] - math.log(total)) < 1e-9
    initial, moved, emitted = hmm.expected(chain, lat, n)
    assert abs(initial.sum() - 4) < 1e-9 and abs(moved.sum() - 5) < 1e-9 and abs(emitted.sum() - 9) < 1e-9
    assert np.allclose(emitted.sum(axis=1), np.bincount(np.concatenate(texts), minlength=n))


def _two_languages():
    rows = []
    for i in range(160):
        own = prose(i % 2, 40).split()
        rows.append((i, " ".join(own[(i * 7 + j * j) % 40] for j in range(60)) + f" rare{i}"))
    return rows


def test_base_is_exact_and_states_help(frame):
    rows = _two_languages()
    got = hmm.language_scores(frame(rows)).collect()
    _check_base(rows, got)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_training_raises_the_likelihood(frame):
    from slotpack.llm.common import store
    docs = store(frame(_two_languages(), extra=False), "docs")
    words = hmm.vocabulary(hmm.word_counts(docs))
    texts = hmm.encoded(docs, words).where("row IS NOT NULL")
    assert abs(words.mass.sum() - 1 - (hmm.ENDINGS - 1) / (words.tokens + words.distinct + 1)) < 1e-9
    chain, values = hmm.start(words.mass), []
    for _ in range(4):
        values.append(hmm.class_scores(texts.where("train"), chain, words.mass).agg({"class_score": "sum"}).first()[0])
        chain = hmm.baum_welch(texts, chain, words.mass)
        assert np.allclose(chain.emit.sum(axis=0), 1) and np.allclose(chain.step.sum(axis=1), 1)
    assert values == sorted(values)


def test_blocks_and_rare_words(frame, monkeypatch):
    monkeypatch.setattr(hmm, "COMMON_SHARE", 50)
    monkeypatch.setattr(hmm, "OWN_SHARE", 20)
    rows = _two_languages()[:60]
    _check_base(rows, hmm.language_scores(frame(rows), rounds=1).collect())


def test_edge_rows(frame, edge_rows):
    got = hmm.language_scores(frame(edge_rows), rounds=1).collect()
    _check_base(edge_rows, got)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    assert hmm.language_scores(frame([]), rounds=1).collect() == []
    held = [(i, "some words here") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    _check_base(held, hmm.language_scores(frame(held), rounds=1).collect())
