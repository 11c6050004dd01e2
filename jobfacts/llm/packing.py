"""Order-preserving packing of tokenised documents into sequences, cut where it costs least."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, small
from jobfacts.llm.tokens import encoder

BLOCK = 1 << 20
#: What a cut costs, in padding tokens: after a document, after a sentence or line, anywhere else; and each sequence.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE, PER_SEQUENCE = 0, 1, 32, 1
#: Inside a sentence longer than this, cuts are offered at every multiple of it.
GRID = 256

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n"]] = True


def sentence_ends(text: bytes, ids: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Positions in tokens right after a sentence or line ends."""
    body = np.frombuffer(text, np.uint8)
    if not len(body):
        return np.empty(0, np.int64)
    stops = np.flatnonzero(_ENDS[body])
    after = np.minimum(stops + 1, len(body) - 1)
    stops = stops[_BLANK[body[after]] | (stops == len(body) - 1) | (body[stops] == 10)]
    return np.unique(np.searchsorted(np.cumsum(n_bytes[ids]), stops + 1) + 1)


def cut_points(ends: np.ndarray, documents: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a cut may be made, from 0 on, and what each costs; no gap is wider than the grid or the limit."""
    places = np.union1d(np.union1d(ends, documents), [0])
    grid = min(GRID, limit)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > grid)
    more = [np.arange(places[i] + grid, places[i + 1], grid) for i in wide]
    every = np.union1d(places, np.concatenate(more)) if more else places
    cost = np.full(len(every), ELSEWHERE, np.int64)
    cost[np.isin(every, ends)] = AT_SENTENCE
    cost[np.isin(every, documents)] = AT_DOCUMENT
    return every, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Least cost of a packing that ends at each place, and the place where its last sequence begins.

    A sequence from i to j costs limit - (j - i) padding, which splits into a part of i and a part of j: the best i of
    the last `limit` tokens stands at the head of a queue whose values only rise. A sequence whose length is a power
    of two isn't padded; the few places that far back are tried beside it.
    """
    at, pay = places.tolist(), cost.tolist()
    n = len(at)
    exact: dict[int, list[int]] = {}
    length = limit // 2
    while length >= max(1, limit // 8):
        back = np.searchsorted(places, places - length)
        back = np.where((back < n) & (places[np.minimum(back, n - 1)] == places - length), back, -1)
        for j in np.flatnonzero(back >= 0).tolist():
            exact.setdefault(j, []).append(int(back[j]))
        length //= 2
    best, came = [0] * n, [0] * n
    queue, values = deque([0]), deque([0])
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - limit:
            queue.popleft()
            values.popleft()
        least, whence = values[0] + limit - here, queue[0]
        if j in exact:
            for i in exact[j]:
                if best[i] < least:
                    least, whence = best[i], i
        least += pay[j] + PER_SEQUENCE
        best[j], came[j] = least, whence
        value = least + here
        while values and values[-1] >= value:
            values.pop()
            queue.pop()
        values.append(value)
        queue.append(j)
    return best, came


def _last_cut(places: np.ndarray, best: list[int], limit: int) -> int:
    """Of the places in the last `limit` tokens that of least cost, the latest of them."""
    first = int(np.searchsorted(places, places[-1] - limit))
    return max(range(max(1, first), len(places)), key=lambda j: (-best[j], j))


class _Packer:
    """Documents go in, pieces come out; what the last cut leaves over begins the next block."""

    def __init__(self, limit: int, sequences_from: int) -> None:
        self.limit, self.sequence = limit, sequences_from
        self.docs: list[tuple] = []  # id, tokens before this part, all tokens, ids of the part, sentence ends in it
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids, ends))
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.docs:
            return None
        stops = np.cumsum([len(d[3]) for d in self.docs])
        starts = stops - [len(d[3]) for d in self.docs]
        ends = np.concatenate([d[4] + s for d, s in zip(self.docs, starts)])
        places, cost = cut_points(ends, stops, self.limit)
        best, came = best_cuts(places, cost, self.limit)
        j = len(places) - 1 if last else _last_cut(places, best, self.limit)
        cuts = [int(places[j])]
        while j:
            j = came[j]
            cuts.append(int(places[j]))
        cuts = np.array(cuts[::-1])
        ids = np.concatenate([d[3] for d in self.docs])
        begins = np.union1d(cuts[:-1], starts[starts < cuts[-1]])
        lengths = np.diff(np.append(begins, cuts[-1]))
        doc = np.searchsorted(stops, begins, "right")
        window = np.searchsorted(cuts, begins, "right") - 1
        flat = ids.astype("<u4").tobytes()
        bounds = np.append(begins, cuts[-1]).astype(np.int64) * 4
        before = np.array([d[1] for d in self.docs])
        total = np.array([d[2] for d in self.docs])
        names = pa.array([d[0] for d in self.docs], pa.int64())
        out = pa.record_batch(
            [
                names.take(pa.array(doc)),
                pa.array(before[doc] + begins - starts[doc], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                pa.array(total[doc], pa.int64()),
                pa.array(self.sequence + window, pa.int64()),
                pa.array(begins - cuts[window], pa.int64()),
            ],
            schema=_SCHEMA,
        )
        self.sequence += len(cuts) - 1
        self._keep_from(int(cuts[-1]), starts, stops)
        return out

    def _keep_from(self, cut: int, starts: np.ndarray, stops: np.ndarray) -> None:
        rest = []
        for (doc_id, before, total, ids, ends), start, stop in zip(self.docs, starts, stops):
            if stop > cut:
                gone = max(0, cut - int(start))
                rest.append((doc_id, before + gone, total, ids[gone:], ends[ends > gone] - gone))
        self.docs, self.held = rest, sum(len(d[3]) for d in rest)


def pack(
    docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of at most `limit` tokens: `PIECES`, ids as little-endian 32-bit numbers.

    A document is the ids of its text by the vocabulary file `vocabulary` (a byte-level BPE in JSON) and then `end_id`;
    a null or empty text is `end_id` alone. Each task packs the documents of its input split in the order in which they
    stand there, so nothing is shuffled; sequence ids are unique, not gapless. Dynamic programming over blocks of
    `BLOCK` tokens puts the cuts at ends of documents and sentences (elsewhere only in sentences longer than `GRID`
    tokens), at the least sum of padding and cut costs; a block's end is itself a cut of least cost, the rest goes on
    into the next block. Only a task's last sequence can be much padded.

    Repeated rows are documents of their own, a null id stays null, other columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        packer = _Packer(limit, TaskContext.get().partitionId() << 40)
        for batch in small(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode.ids(text)
                ends = sentence_ends(text.encode(), ids, encode.n_bytes)
                ids = np.append(ids, np.uint32(end_id))
                packer.add(doc_id, ids, ends[ends < len(ids)])
                if packer.held >= BLOCK:
                    yield packer.flush(last=False)
        if (out := packer.flush(last=True)) is not None:
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(rows, run, PIECES)
