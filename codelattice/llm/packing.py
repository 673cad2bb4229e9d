"""Operator 2: order-preserving packing of documents into windows of at most 1024 tokens.

Documents are packed where they lie, in the order in which a partition holds them, so nothing is
shuffled. A block of documents is one run of ids. It may be cut at the end of a document (free), at
the end of a sentence (a small penalty) or, where neither is near, between any tokens (a larger
one). The cuts that minimise padding plus penalties are found by dynamic programming:

    cost[j] = penalty[j] + size + min over i of (cost[i] - (at[j] - at[i])),  at[j] - at[i] <= size

The least of cost[i] + at[i] over a sliding window comes from a monotone queue, so a block takes
linear time. The last window of a block is left open and begins the next block.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .tokens import encoder

SIZE = 1024
BLOCK_TOKENS = 1 << 17
SENTENCE_PENALTY, MIDDLE_PENALTY = 2, 10
#: Cuts inside sentences are offered every MIDDLE_STEP tokens of a stretch of more than MIDDLE_GAP without another cut; of sentence ends, one every SENTENCE_STEP tokens.
MIDDLE_GAP, MIDDLE_STEP, SENTENCE_STEP = 48, 16, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cut string"


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into `at` of the chosen cuts, from the first place to the last.

    at: ascending places from 0 on, neighbours at most `size` apart. penalty: of a cut at each.
    """
    places, costs = at.tolist(), penalty.tolist()
    n = len(places)
    keyed, back = [0.0] * n, [0] * n  # cost + place; the cut before
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = places[j]
        while places[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = keyed[j] = keyed[i] - here + size + costs[j] + here
        while queue and keyed[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a run of ids may be cut, and penalties. ends: ascending ends of documents; the last is len(ids)."""
    inner = np.flatnonzero(sentence_end[ids]) + 1
    if len(inner):
        cell = inner // SENTENCE_STEP
        inner = inner[np.append(cell[1:] != cell[:-1], True)]
    inner = np.setdiff1d(inner, ends, assume_unique=True)
    known = np.union1d(np.append(0, ends), inner)
    gap = np.diff(known)
    far = np.flatnonzero(gap > min(MIDDLE_GAP, size))
    step = min(MIDDLE_STEP, size)
    middle = np.concatenate([np.arange(known[k] + step, known[k + 1], step) for k in far]) if len(far) else np.empty(0, np.int64)
    at = np.concatenate([np.append(0, ends), inner, middle])
    cost = np.concatenate([np.zeros(len(ends) + 1), np.full(len(inner), SENTENCE_PENALTY), np.full(len(middle), MIDDLE_PENALTY)])
    order = np.argsort(at, kind="stable")
    return at[order].astype(np.int64), cost[order]


class Packer:
    """Packs a stream of (doc_id, ids) and returns pieces; sequences are numbered from `first` on."""

    def __init__(self, sentence_end: np.ndarray, first: int, size: int = SIZE):
        self.sentence_end, self.next, self.size = sentence_end, first, size
        self.runs: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, place in its document, its tokens, ids
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.runs.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all windows but the open last one, or of all."""
        if not self.runs:
            return []
        ids = np.concatenate([r[3] for r in self.runs]).astype("<u4")
        ends = np.cumsum([len(r[3]) for r in self.runs])
        at, penalty = cut_places(ids, ends, self.sentence_end, self.size)
        cuts = at[best_cuts(at, penalty, self.size)]
        kind = dict(zip(at.tolist(), penalty.tolist()))
        if not last:
            if len(cuts) < 3:
                return []
            cuts = cuts[:-1]
        begins = ends - np.diff(ends, prepend=0)
        bounds = np.union1d(cuts, begins[begins < cuts[-1]])
        which, window = np.searchsorted(begins, bounds[:-1], "right") - 1, np.searchsorted(cuts, bounds[:-1], "right") - 1
        view, out = memoryview(ids).cast("B"), []
        names = {0.0: "document", float(SENTENCE_PENALTY): "sentence", float(MIDDLE_PENALTY): "middle"}
        begins_l, cuts_l = begins.tolist(), cuts.tolist()
        for a, b, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), which.tolist(), window.tolist()):
            doc_id, skipped, total, _ = self.runs[d]
            out.append((doc_id, skipped + a - begins_l[d], b - a, zlib.crc32(view[4 * a : 4 * b]), total, self.next + w, a - cuts_l[w], cuts_l[w + 1] - cuts_l[w], names[kind[cuts_l[w + 1]]]))
        self.next += len(cuts_l) - 1
        rest, upto = [], cuts_l[-1]
        for (doc_id, skipped, total, run), a, b in zip(self.runs, begins_l, ends.tolist()):
            if b > upto:
                gone = max(0, upto - a)
                rest.append((doc_id, skipped + gone, total, run[gone:]))
        self.runs, self.held = rest, sum(len(r[3]) for r in rest)
        return out


def sentence_ends(vocabulary: str, spaces: bool) -> np.ndarray:
    """For each id whether its text ends a sentence or a line."""
    out = np.zeros(1 << 16, bool)
    for token, i in encoder(vocabulary, spaces).model()["vocab"].items():
        out[i] = token.removesuffix("</w>").endswith((".", "!", "?", "Ċ"))
    return out


def pack(docs: DataFrame, vocabulary: str, spaces: bool = True, end: int = 0, size: int = SIZE) -> DataFrame:
    """Pieces of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; also sequence_tokens and how the sequence was cut at its end.

    Each document is its ids and the end id; a null or empty text is the end id alone, a null doc_id
    is kept, repeated rows are packed each for itself, and an empty table gives no piece. Texts of
    any length are cut into as many windows as they need. Other columns are dropped. sequence_id is
    unique: the input partition's number times 2**32 plus a count.
    """
    out = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("cut", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, stop = encoder(vocabulary, spaces), np.array([end], np.uint16)
        packer = Packer(sentence_ends(vocabulary, spaces), TaskContext.get().partitionId() << 32, size)

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) if pieces else [[] for _ in out]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, out)], [n for n, _ in out])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, np.concatenate([encode(text), stop]))
                    if packer.held >= BLOCK_TOKENS:
                        yield batch_of(packer.flush(last=False))
        yield batch_of(packer.flush(last=True))
        packer = batch = part = None
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
