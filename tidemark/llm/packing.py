"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_and_text
from .units import unit_ids

#: Sequences that are filled together; what is held at once is this many sequences of ids.
POOL = 256
#: Distinct units of text whose ids a worker keeps: fewer than usual, as a worker may serve other stages beside.
UNITS = 40_000


def attention_cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


class Packer:
    """Sequences that are filled at once, of the documents of one stream.

    Documents wait until their tokens fill ``pool`` sequences. Then as many sequences are opened as the waiting tokens
    need beyond the room that is open, and the documents go, in descending size, each whole to the sequence of lowest
    attention cost so far that has room for it. What fits nowhere waits for the next pool, and so do sequences with
    room; one with less than ``gap`` left is done, and padded. Documents are cut where a quarter of the pool is left
    waiting, which many documents of over half a sequence cause, and at the end of the stream: to fill what is open.
    """

    def __init__(self, capacity: int, pool: int, linear: float, quadratic: float):
        self.capacity, self.pool, self.linear, self.quadratic = capacity, pool, linear, quadratic
        self.gap = max(1, capacity // 128)
        self.waiting: list[tuple[int, tuple]] = []
        self.tokens = 0
        self.open: list[list] = []  # [cost, number, room, pieces]
        self.opened = 0

    def _new(self) -> list:
        self.opened += 1
        return [0.0, self.opened, self.capacity, []]

    def add(self, size: int, document: tuple) -> Iterator[list[tuple[tuple, int, int]]]:
        """Takes a document of at most the capacity; gives the sequences that are done, of (document, start, length)."""
        self.waiting.append((size, document))
        self.tokens += size
        if self.tokens >= self.pool * self.capacity:
            yield from self._place()

    def _put(self, sequence: list, document: tuple, start: int, n: int) -> None:
        sequence[3].append((document, start, n))
        sequence[2] -= n
        sequence[0] += attention_cost(n, self.linear, self.quadratic)

    def _place(self) -> Iterator[list[tuple[tuple, int, int]]]:
        room = sum(s[2] for s in self.open)
        self.open += [self._new() for _ in range(max(0, self.tokens - room) // self.capacity)]
        heapq.heapify(self.open)
        rest, full = [], []
        for size, document in sorted(self.waiting, key=lambda w: -w[0]):
            passed = []
            while self.open:
                sequence = heapq.heappop(self.open)
                if sequence[2] >= size:
                    self._put(sequence, document, 0, size)
                    (full if sequence[2] < self.gap else passed).append(sequence)
                    break
                passed.append(sequence)
            else:
                rest.append((size, document))
            for sequence in passed:
                heapq.heappush(self.open, sequence)
        self.waiting, self.tokens = rest, sum(size for size, _ in rest)
        if self.tokens > self.pool * self.capacity // 4:
            self._cut()
            full += [s for s in self.open if s[2] < self.gap]
            self.open = [s for s in self.open if s[2] >= self.gap]
        if len(self.open) > 2 * self.pool:
            self.open.sort(key=lambda s: -s[2])
            full += self.open[2 * self.pool :]
            del self.open[2 * self.pool :]
        yield from (s[3] for s in full)

    def _cut(self) -> None:
        """Cuts all waiting documents into the open sequences, lowest cost first, and into new ones."""
        gaps = deque(sorted(self.open))
        for size, document in self.waiting:
            start = 0
            while start < size:
                if not gaps:
                    gaps.append(self._new())
                    self.open.append(gaps[0])
                n = min(gaps[0][2], size - start)
                self._put(gaps[0], document, start, n)
                start += n
                if not gaps[0][2]:
                    gaps.popleft()
        self.waiting, self.tokens = [], 0

    def finish(self) -> Iterator[list[tuple[tuple, int, int]]]:
        """The sequences that are left; one at most is padded by more than the gap, but for those with no document to fill them."""
        yield from self._place()
        self._cut()
        kept = [s for s in self.open if s[3]]
        self.open = []
        yield from self._closed_up(kept)

    def _closed_up(self, sequences: list) -> Iterator[list[tuple[tuple, int, int]]]:
        """Moves the documents of the emptiest sequences into the room of the others, cutting them, while that fills one whole."""
        sequences.sort(key=lambda s: s[2])
        while len(sequences) > 1 and sum(s[2] for s in sequences[:-1]) >= self.capacity - sequences[-1][2]:
            left = [s for s in sequences[:-1] if s[2]]
            for document, base, size in sequences.pop()[3]:
                start = 0
                while start < size:
                    n = min(left[-1][2], size - start)
                    self._put(left[-1], document, base + start, n)
                    start += n
                    if not left[-1][2]:
                        left.pop()
        yield from (s[3] for s in sequences)


def _pieces(stream: Iterable[tuple[int, bytes]], capacity: int, pool: int, linear: float, quadratic: float) -> Iterator[tuple]:
    """(doc_id, start, length, crc, doc_tokens, local sequence, offset) for (doc_id, ids as 32-bit bytes)."""
    packer, number = Packer(capacity, pool, linear, quadratic), 0

    def rows(done: Iterable[list[tuple[tuple, int, int]]]) -> Iterator[tuple]:
        nonlocal number
        for held in done:
            offset = 0
            for (doc_id, base, data, whole), start, n in held:
                yield doc_id, base + start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), whole, number, offset
                offset += n
            number += 1

    for doc_id, data in stream:
        whole = len(data) // 4
        cut = whole - whole % capacity
        yield from rows([((doc_id, 0, data, whole), start, capacity)] for start in range(0, cut, capacity))
        if cut < whole:
            yield from rows(packer.add(whole - cut, (doc_id, cut, data[4 * cut :], whole)))
    yield from rows(packer.finish())


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, pool: int = POOL, linear: float = 1.0, quadratic: float = 1.0 / 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` (a power of two) tokens; one row per piece.

    A document is its ids and ``end_id``. Whole multiples of the capacity are sequences of their own; the remainders
    of each scan partition are packed by ``Packer``, whole but for a few at the partition's end. Nothing is shuffled: a sequence holds documents of
    one partition, its id is the partition's number and a count, and a task that runs again gives the same rows.

    Null or empty text is the end id alone. Repeated rows are packed each. A null id stays null. Empty table: no
    rows. Very long texts are cut into full sequences. Other columns are ignored.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches):
        encoder, end = unit_ids(tokenizer, UNITS), end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36

        def stream():
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                        yield doc_id, ids + end

        rows: list[tuple] = []
        for row in _pieces(stream(), capacity, pool, linear, quadratic):
            rows.append(row)
            if len(rows) == 20_000:
                yield _batch(rows, base)
                rows = []
        if rows:
            yield _batch(rows, base)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def _batch(rows: list[tuple], base: int) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    columns[5] = pa.array([base + s for s in columns[5].to_pylist()], pa.int64())
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
