"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from forumlens.llm.batches import slices
from forumlens.llm.tokens import encoder

FIELDS = "start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
TASK_SHIFT = 40  # sequences of a task are numbered from its partition id times 2**40
OUT_BYTES = 4 << 20


class SumOfSquares:
    """Windows of `size` tokens that are being filled.

    `level[h]` counts the open windows holding h tokens. An item of s tokens
    goes where the sum of squares of `level` afterwards is least: from level h
    to h + s, or into a new window. Full windows leave the array. Ties go to
    the fullest window.
    """

    def __init__(self, size: int):
        self.size, self.level = size, np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, item, length: int) -> list | None:
        """Put an item of 1 to size - 1 tokens; gives back the window if that fills it."""
        size, level = self.size, self.level
        held = np.flatnonzero(level[1 : size - length + 1]) + 1
        to = held + length
        change = 1 - 2 * level[held] + np.where(to < size, 2 * level[to] + 1, 0)
        best, window = 0, []
        if len(held):
            at = len(held) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= 2 * level[length] + 1:
                best = int(held[at])
        if best:
            level[best] -= 1
            window = self.open[best].pop()
        window.append((item, length))
        if best + length == size:
            return window
        level[best + length] += 1
        self.open.setdefault(best + length, []).append(window)
        return None

    def rest(self) -> list:
        """Items of all open windows, fullest window first."""
        return [x for h in sorted(self.open, reverse=True) for window in self.open[h] for x in window]


def _pieces(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, path: str, size: int, end_id: int, first: int):
    """Pieces (id, start, ids, doc_tokens, sequence, offset) of one task's documents."""
    packer, sequence = SumOfSquares(size), first

    def closed(window):
        nonlocal sequence
        offset = 0
        for (doc, start, ids, total), length in window:
            yield doc, start, ids, total, sequence, offset
            offset += length
        sequence += 1

    for batch in batches:
        for part in slices(batch, text_col):
            ids, at = encoder(path).encode(part.column(text_col))
            for i, doc in enumerate(part.column(id_col).to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                total = len(own)
                for start in range(0, total - size + 1, size):  # whole windows of a long document
                    yield from closed([((doc, start, own[start : start + size], total), size)])
                if left := total % size:
                    window = packer.place((doc, total - left, own[total - left :], total), left)
                    if window:
                        yield from closed(window)
    # What is still open at the end is laid out without gaps; the last, partial
    # window is cut to powers of two, which need no padding.
    rest = packer.rest()
    left = sum(length for _, length in rest)
    room, window = (size if left >= size else 1 << (left.bit_length() - 1)) if left else 0, []
    for (doc, start, ids, total), length in rest:
        while length:
            take = min(room, length)
            window.append(((doc, start, ids[:take], total), take))
            start, ids, length, room, left = start + take, ids[take:], length - take, room - take, left - take
            if not room:
                yield from closed(window)
                window, room = [], size if left >= size else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens.

    Every task packs the documents of its input split in the order read, so
    nothing is shuffled and a lost task gives the same pieces again. Documents
    longer than a window are cut at whole windows; their tails and all shorter
    documents are placed by `SumOfSquares`. What is left open at the end of a
    split is joined into full windows by cutting, and the last remainder into
    sequences of power-of-two length, so no sequence needs padding.

    A piece has its document's id, `start` (ids of the document before it),
    `length`, `tokens` (little-endian unsigned 32-bit ids), `doc_tokens`
    (with the end id), `sequence_id` and `offset` in the sequence. A null or
    empty text is the end id alone. Repeated rows are packed once each; a null
    id is kept. An empty table gives no piece. Other columns are ignored.
    """
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        def table(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], types[0]),
                    pa.array(cols[1], pa.int64()),
                    pa.array(map(len, cols[2]), pa.int64()),
                    pa.array([x.tobytes() for x in cols[2]], pa.binary()),
                    *(pa.array(c, pa.int64()) for c in cols[3:]),
                ],
                [id_col, *(f.split()[0] for f in FIELDS.split(", "))],
            )

        def typed():
            for batch in batches:
                types[:] = [batch.schema.field(id_col).type]
                yield batch

        rows, held, types = [], 0, [pa.int64()]
        first = TaskContext.get().partitionId() << TASK_SHIFT
        for piece in _pieces(typed(), id_col, text_col, tokenizer, size, end_id, first):
            rows.append(piece)
            held += 4 * len(piece[2]) + 100
            if held > OUT_BYTES:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    return docs.mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
