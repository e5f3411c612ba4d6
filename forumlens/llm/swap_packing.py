"""Packing whole documents into few sequences by swap-based local search over underfull bins."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import give_back, slices
from forumlens.llm.byte_tokens import byte_encoder
from forumlens.session import written

FIELDS = "piece int, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
TASK_SHIFT = 40  # sequences of a task are numbered from its partition id times 2**40
SECOND = 1 << 62  # and those of the second round from here
ROUND_TOKENS = 8 << 20  # packed at a time by a task; what stays underfull meets the next round
PASSED_BINS = 8  # of the emptiest bins of a task go to the second round
PASSED_FILL = 0.9  # if they are filled up to this share at most
GROUP_TASKS = 512  # whose passed bins meet in one group of the second round
OUT_BYTES = 4 << 20


def best_fit_decreasing(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Items by falling length, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room
    rooms = 0  # bit r is set where at[r] holds a bin
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > need:
            at[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins


def least_bins(lengths: Sequence[int], size: int) -> int:
    """A number of bins that no packing can go below.

    For every a: items above size - a have their bins alone among items of a
    or more; those above half the size have one each, and items from a to half
    the size fill the room of these before they need bins of their own.
    """
    count = np.bincount(np.asarray(lengths, np.int64), minlength=size + 1)
    total = np.cumsum(count * np.arange(size + 1))
    upto = np.cumsum(count)
    a = np.arange(1, size // 2 + 1)
    half = size // 2
    alone, large = upto[size] - upto[size - a], upto[size - a] - upto[half]
    middle = total[half] - total[a - 1]
    room = large * size - (total[size - a] - total[half])
    bound = alone + large + np.maximum(0, -(-(middle - room) // size))
    return int(max(bound.max(initial=0), -(-total[size] // size)))


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills, until bins are empty.

    A donor bin gives one or two of its items to a fuller bin, which may give
    back one or two: a move, a swap of one for one, or of two for one in either
    direction. The receiver's fill rises by what the donor's falls, so every
    exchange raises the sum of squares, and a donor that has nothing left is
    dropped. Donors are taken from the emptiest on; for each the exchange that
    fills a receiver completely comes first, then the one that leaves it the
    least room. `takes[n]` lists what a bin could give up to be filled exactly
    by n tokens, so that the exchanges for given items are looked up.
    """

    def __init__(self, lengths: Sequence[int], bins: list[list[int]], size: int):
        self.lengths, self.size = lengths, size
        self.bins = {b: list(items) for b, items in enumerate(bins)}
        self.fill = {b: sum(lengths[i] for i in items) for b, items in self.bins.items()}
        self.takes: dict[int, dict[tuple[int, tuple[int, ...]], None]] = defaultdict(dict)
        self.keys = 0  # bit n is set where takes[n] holds something
        self.least = least_bins(lengths, size)

    def _given(self, b: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Nothing, one item or two items of a bin, each combination of lengths once."""
        room = self.size - self.fill[b]
        own = sorted({self.lengths[i]: i for i in self.bins[b]}.items())
        yield room, ()
        for n, i in own:
            yield room + n, (i,)
        twice = defaultdict(list)
        for i in self.bins[b]:
            twice[self.lengths[i]].append(i)
        for (n, i), (m, j) in combinations(own, 2):
            yield room + n + m, (i, j)
        for n, same in twice.items():
            if len(same) > 1:
                yield room + 2 * n, (same[0], same[1])

    def _enter(self, b: int) -> None:
        if self.fill[b] < self.size:
            for n, items in self._given(b):
                self.takes[n][b, items] = None
                self.keys |= 1 << n

    def _leave(self, b: int) -> None:
        if self.fill[b] < self.size:
            for n, items in self._given(b):
                held = self.takes[n]
                held.pop((b, items), None)
                if not held:
                    self.keys &= ~(1 << n)

    def _receiver(self, donor: int, n: int, given: int, limit: int):
        """(room left, bin, items it gives back) of the best exchange for `given` items of n tokens in all.

        The receiver is as full as the donor or fuller, gains, and is left with
        less room than `limit`. Its room now bounds what it can be left with,
        so the search ends at the donor's room.
        """
        least, left = self.fill[donor], 0
        limit = min(limit, self.size - least)
        keys = (self.keys >> n) & ((1 << limit) - 1)
        while keys:
            step = (keys & -keys).bit_length() - 1
            left += step
            for b, back in self.takes[n + left]:
                full = self.fill[b]
                if full >= least and left < self.size - full and given + len(back) <= 3 and b != donor:
                    if given == 1 or len(back) == 1:
                        return left, b, back
            keys >>= step + 1
            left += 1
        return None

    def _offers(self, b: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        for _, items in sorted(self._given(b), key=lambda x: (len(x[1]), -x[0])):
            if items:
                yield sum(self.lengths[i] for i in items), items

    def _improve(self, donor: int) -> bool:
        """Make the best exchange of a donor, if it has one."""
        best, limit = None, self.size
        for n, items in self._offers(donor):
            if found := self._receiver(donor, n, len(items), limit):
                best, limit = (found, items), found[0]
                if not limit:
                    break
        if best is None:
            return False
        (_, b, back), items = best
        for x in (donor, b):
            self._leave(x)
        self.bins[donor] = [i for i in self.bins[donor] if i not in items] + list(back)
        self.bins[b] = [i for i in self.bins[b] if i not in back] + list(items)
        for x in (donor, b):
            self.fill[x] = sum(self.lengths[i] for i in self.bins[x])
            if self.fill[x]:
                self._enter(x)
            else:
                del self.bins[x], self.fill[x]
        return True

    def run(self) -> list[list[int]]:
        """The bins when no donor has an exchange left, or when no packing can have fewer."""
        for b in self.bins:
            self._enter(b)
        changed = True
        while changed and len(self.bins) > self.least:
            changed = False
            donors = [(f, b) for b, f in self.fill.items() if f < self.size]
            heapq.heapify(donors)
            while donors and len(self.bins) > self.least:
                _, b = heapq.heappop(donors)
                while b in self.fill and self.fill[b] < self.size and self._improve(b):
                    changed = True
        # what room is left is gathered in the emptiest bin, for whoever packs it with others
        if self.bins:
            b = min(self.fill, key=lambda b: (self.fill[b], b))
            while b in self.fill and self.fill[b] < self.size and self._improve(b):
                pass
        return list(self.bins.values())


def pack_lengths(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Bins of item numbers; each length is 1 to `size`."""
    return LocalSearch(lengths, best_fit_decreasing(lengths, size), size).run()


def _cut(doc, own: np.ndarray, size: int):
    """(doc, piece, start, ids, doc_tokens): whole pieces of `size`, the remainder first."""
    total = len(own)
    first = total % size or size
    borders = [0, *range(first, total + 1, size)]
    for piece, (a, b) in enumerate(zip(borders, borders[1:])):
        yield doc, piece, a, own[a:b], total


class _Rounds:
    """Pieces of one task or group, packed some at a time."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence = size, first
        self.held, self.tokens = [], 0

    def closed(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield *piece, self.sequence, offset
            offset += len(piece[3])
        self.sequence += 1

    def add(self, piece) -> Iterator[tuple]:
        if len(piece[3]) == self.size:
            yield from self.closed([piece])
            return
        self.held.append(piece)
        self.tokens += len(piece[3])
        if self.tokens >= ROUND_TOKENS:
            yield from self.pack(PASSED_BINS)

    def pack(self, passed: int) -> Iterator[tuple]:
        """Close all bins but, at most, the `passed` emptiest ones, which stay held."""
        bins = pack_lengths([len(x[3]) for x in self.held], self.size)
        filled = [sum(len(self.held[i][3]) for i in b) for b in bins]
        order = sorted(range(len(bins)), key=filled.__getitem__)
        kept = {b for b in order[:passed] if filled[b] <= PASSED_FILL * self.size}
        for b in range(len(bins)):
            if b not in kept:
                yield from self.closed([self.held[i] for i in bins[b]])
        self.held = [self.held[i] for b in sorted(kept) for i in bins[b]]
        self.tokens = sum(len(x[3]) for x in self.held)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        cols = list(zip(*held))
        cols[3:4] = [map(len, cols[3]), [x.tobytes() for x in cols[3]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += 4 * len(row[3]) + 100
        if size > OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _schema(id_col: str, id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    kinds = [pa.int32(), long, long, pa.binary(), long, long, long]
    return pa.schema([(id_col, id_type), *zip([f.split()[0] for f in FIELDS.split(", ")], kinds)])


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into as few sequences of at most `size` tokens as the search finds.

    A document is its ids under a byte-level tokenizer file and an end id. Only
    documents longer than a sequence are cut: into pieces of `size` tokens, of
    which the first may be shorter. Every task packs the pieces of its input
    split, some millions of tokens at a time: by best fit on falling lengths,
    then by `LocalSearch`. A task's few emptiest bins are opened again and
    packed with those of up to `GROUP_TASKS` tasks in a second round, so many
    small splits cost no sequences. The first round is written once to the
    shared folder; only the passed bins are shuffled.

    A piece has its document's id, `piece` (from 0), `start` (ids of the
    document before it), `length`, `tokens` (little-endian unsigned 32-bit
    ids), `doc_tokens` (with the end id), `sequence_id` and `offset` in the
    sequence, without gaps. A null or empty text is the end id alone. Texts
    have any length. Repeated rows are packed once each; a null id is kept. An
    empty table gives no piece. Other columns of the table are ignored, so
    their names cannot clash; an id column of the name of a result column is
    refused.
    """
    if id_col in {f.split()[0] for f in FIELDS.split(", ")}:
        raise ValueError(f"the id column {id_col} has the name of a result column; rename it")
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rounds, types = _Rounds(size, task << TASK_SHIFT), [pa.int64()]

        def rows():
            for batch in batches:
                types[0] = batch.schema.field(0).type
                for part in slices(batch, text_col):
                    ids, at = byte_encoder(tokenizer).encode(part.column(1))
                    for i, doc in enumerate(part.column(0).to_pylist()):
                        own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                        for piece in _cut(doc, own, size):
                            yield from rounds.add(piece)
            if rounds.held:
                yield from rounds.pack(PASSED_BINS)
            for piece in rounds.held:  # no sequence yet
                yield *piece, -1 - task // GROUP_TASKS, 0

        made = rows()
        for row in made:  # the id's type is known from the first batch on
            def all_rows(row=row):
                yield row
                yield from made

            yield from _batches(all_rows(), _schema(id_col, types[0]))
        give_back()

    schema = f"`{id_col}` {kind}, {FIELDS}"
    packed = written(docs.mapInArrow(first, schema), "packed")

    def second(rows: pa.Table) -> pa.Table:
        group = -1 - rows.column("sequence_id")[0].as_py()
        rounds = _Rounds(size, SECOND + (group << TASK_SHIFT))
        out_schema = rows.schema
        columns = [rows.column(c).to_pylist() for c in (id_col, "piece", "start", "tokens", "doc_tokens")]
        pieces = sorted(zip(*columns), key=lambda x: (repr(x[0]), x[1]))
        rounds.held = [(d, p, s, np.frombuffer(t, "<u4"), n) for d, p, s, t, n in pieces]
        return pa.Table.from_batches(list(_batches(rounds.pack(0), out_schema)), out_schema)

    again = packed.where(F.col("sequence_id") < 0).groupBy("sequence_id").applyInArrow(second, schema)
    return packed.where(F.col("sequence_id") >= 0).unionByName(again)
