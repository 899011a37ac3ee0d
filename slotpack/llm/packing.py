"""Packing: order-preserving dynamic programming over window cuts.

Documents keep their order; each is its token ids and one end id. The stream of a partition is cut
into windows of at most ``window`` ids. Cuts may fall at document ends (free), sentence ends or, as
a last resort, on a grid inside sentences (penalised). The program minimises padding plus penalties:
with f(j) the best cost of a stream that is cut at j, and i running over cuts at most ``window``
before j, f(j) = min f(i) + window - (j - i) + penalty(j). The minimum of f(i) + i slides with j and
is kept in a monotone queue, so the work is linear in the number of possible cuts.

Each partition packs on its own and without a shuffle. The stream is handled in blocks; the ids after
the last cut of a block, up to one window of them, cost nothing: they go on into the next block, and at
the end of the partition they are split into powers of two, which need no padding. So the last cut is the
one with the least f among those from which one window reaches the end.

Defined results: null text counts as empty, whose only id is the end id; a text of any length is cut into
as many windows as it needs; repeated rows and null ids are packed like any other row; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slotpack.llm.common import map_batches
from slotpack.llm.tokens import tokens
from slotpack.llm.words import text_pieces

WINDOW = 2048
END_ID = 1
#: Cost, in padded ids, of a cut at a sentence end and of a cut inside a sentence.
SENTENCE_PENALTY, INNER_PENALTY = 4, 16
#: Possible cuts inside sentences are this many ids apart.
GRID = 32
BLOCK = 1 << 20
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: list[int], penalty: list[int], window: int, open_end: bool = False) -> list[int]:
    """Cuts of the cheapest path from 0 to at[-1]; ``at`` ascends with steps of at most ``window``.

    With ``open_end`` what follows the last cut is free as long as it is at most one window, and at[-1] is
    no cut unless the path that ends there is the cheapest; of equally cheap paths the longest counts.
    The queue holds candidates with ascending f(i) + i; candidates that fall out of the window leave
    in front, candidates that a newer one beats leave at the back.
    """
    pos, total, origin = [0, *at], [0] * (len(at) + 1), [0] * (len(at) + 1)
    queue, head = [0], 0
    for j in range(1, len(pos)):
        oldest = pos[j] - window
        while pos[queue[head]] < oldest:
            head += 1
        origin[j] = queue[head]
        total[j] = cost = total[queue[head]] + window + penalty[j - 1]  # f(j) + j
        while len(queue) > head and total[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at)
    if open_end:
        reach = [k for k in range(len(pos)) if pos[k] >= pos[-1] - window]
        j = min(reversed(reach), key=lambda k: total[k] - pos[k])
    while j:
        cuts.append(pos[j])
        j = origin[j]
    return cuts[::-1]


def powers(n: int) -> list[int]:
    """Descending powers of two that sum to ``n``."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


@dataclass
class Stream:
    """Documents of one partition whose windows are not all complete."""

    window: int
    sequence: int
    closing: np.ndarray
    docs: list[tuple[object, int, int, np.ndarray]] = field(default_factory=list)  # (doc_id, start, all ids, ids)
    size: int = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def take(self, last: bool) -> Iterator[tuple]:
        """Pieces of the complete windows; with ``last`` also of the rest. The others stay."""
        if not self.docs:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        cost = np.full(len(ids) + 1, 255, np.uint8)
        cost[GRID::GRID] = INNER_PENALTY
        cost[np.flatnonzero(self.closing[np.minimum(ids, len(self.closing) - 1)]) + 1] = SENTENCE_PENALTY
        cost[ends] = 0
        cost[0] = 255
        at = np.flatnonzero(cost < 255)
        cuts = best_cuts(at.tolist(), cost[at].tolist(), self.window, open_end=True)
        rest = cuts[-1] if cuts else 0
        if last:
            cuts += (rest + np.cumsum(powers(len(ids) - rest), dtype=np.int64)).tolist()
        yield from self._pieces(ids, ends, cuts)
        if last:
            self.docs, self.size = [], 0
        else:
            self._drop(ends, rest)

    def _pieces(self, ids: np.ndarray, ends: np.ndarray, cuts: list[int]) -> Iterator[tuple]:
        k, begin = 0, 0
        first = ends - [len(d[3]) for d in self.docs]
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc_id, start, total, _ = self.docs[k]
                stop = min(cut, int(ends[k]))
                yield (doc_id, start + begin - int(first[k]), stop - begin, zlib.crc32(ids[begin:stop].tobytes()),
                       total, self.sequence, offset)
                offset += stop - begin
                begin = stop
                k += begin == ends[k]
            self.sequence += 1

    def _drop(self, ends: np.ndarray, rest: int) -> None:
        """Forget the ids before ``rest``."""
        self.size = int(ends[-1]) - rest
        k = int(np.searchsorted(ends, rest, side="right"))
        if k == len(self.docs):
            self.docs = []
            return
        doc_id, start, total, own = self.docs[k]
        gone = rest - (int(ends[k]) - len(own))
        self.docs = [(doc_id, start + gone, total, own[gone:].copy()), *self.docs[k + 1:]]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    ``sequence_id`` is the partition in the upper half and a running number in the lower.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(vocabulary)
        stream = Stream(window, TaskContext.get().partitionId() << 32, encode.sentence_end)
        end = np.array([end_id], np.uint32)
        for b in batches:
            own = b.column("doc_id").type
            for begin, texts in text_pieces(b.column("text")):
                names = b.column("doc_id").slice(begin, len(texts)).to_pylist()
                for doc_id, text in zip(names, texts, strict=True):
                    stream.add(doc_id, np.concatenate([encode.ids(text), end]))
                    if stream.size >= BLOCK:
                        yield _table(list(stream.take(last=False)), own)
        if stream.docs:
            yield _table(list(stream.take(last=True)), own)

    return map_batches(docs.select("doc_id", "text"), run, schema)


def _table(pieces: list[tuple], doc_id: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*pieces, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, doc_id if i == 0 else pa.int64()) for i, c in enumerate(columns)], names)
