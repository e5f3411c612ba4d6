"""Benchmark passages in documents, found with an FM-index per shard of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import FOLD, flat, ragged, slices, split_words
from forumlens.session import written

WINDOW = 13
PATTERN_WORDS = 2_000_000  # words of benchmark texts sent to the executors at a time
SHARD_BYTES = 4 << 20  # text indexed at a time
SAMPLE = 8  # every eighth text position is kept for locating
# Bytes that end a word: everything in ASCII but digits and lower-case letters.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Patterns:
    """Distinct windows of some items: sorted word keys, windows as word numbers from 1, items of each window."""

    vocabulary: np.ndarray
    windows: list[np.ndarray]  # one matrix for each length
    items: list[list[tuple]]  # parallel to the rows of all matrices in turn
    shortest: int


def patterns(rows: list[tuple[str | None, str | None]], window: int) -> Patterns:
    """Windows of `window` words of each item; a shorter item is one window, an empty one none."""
    words = split_words(pa.array([t for _, t in rows], pa.string()), BREAKS, FOLD)
    vocabulary, symbols = np.unique(words.keys, return_inverse=True)
    symbols = symbols.astype(np.int32) + 1
    found: dict[int, dict[bytes, set]] = {}
    for i, (item, _) in enumerate(rows):
        own = symbols[words.first[i] : words.first[i + 1]]
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(own[at : at + size].tobytes(), set()).add(item)
    sizes = sorted(found)
    return Patterns(
        vocabulary,
        [np.frombuffer(b"".join(found[n]), np.int32).reshape(-1, n) for n in sizes],
        [sorted(i for i in items if i is not None) for n in sizes for items in found[n].values()],
        sizes[0] if sizes else window,
    )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    values = text[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    step = 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        key, who = key[by], tied[by]
        group = rank[who]
        at = np.arange(len(who))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        rank[who] = group + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Ranks in a sequence of small numbers: one bit plane per binary digit, zeros sorted before ones."""

    def __init__(self, values: np.ndarray, top: int):
        self.planes = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            ranks = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.planes.append((bit, ranks, len(values) - int(ranks[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(ends), ends
        for bit, ranks, zeros in self.planes:
            one = ((symbols >> bit) & 1).astype(bool)
            low_ones, high_ones = ranks[low], ranks[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


class FMIndex:
    """Backward search over stretches of word numbers; symbol 0 stands between stretches."""

    def __init__(self, stretches: np.ndarray, begin: np.ndarray, top: int):
        """stretches: their words in a row; begin: where each starts, and the length at the end."""
        count, n = len(begin), len(stretches)  # separators, one before each stretch and one at the end
        place = np.arange(n) + np.repeat(np.arange(count - 1), np.diff(begin)) + 1
        text = np.zeros(n + count, np.int64)
        text[place] = stretches + count
        text[begin + np.arange(count)] = np.arange(count)
        order = suffix_array(text)
        self.source = np.full(n + count, -1, np.int64)
        self.source[place] = np.arange(n)
        flat_text = np.zeros(n + count, np.int64)
        flat_text[place] = stretches
        before = flat_text[order - 1]
        before[order == 0] = 0
        self.bwt, self.tree = before, WaveletTree(before, top)
        counts = np.bincount(flat_text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # Positions kept: every SAMPLE-th and each stretch's first word, so that no walk leaves its stretch.
        kept = order % SAMPLE == 0
        kept |= before == 0
        self.kept, self.kept_rank, self.kept_at = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the matrix that occur, and their ranges of suffixes."""
        last = windows[:, -1]
        low, high = self.first[last], self.first[last + 1]
        rows = np.arange(len(windows))
        for at in range(windows.shape[1] - 2, -1, -1):
            some = low < high
            rows, low, high = rows[some], low[some], high[some]
            symbols = windows[rows, at]
            base = self.first[symbols]
            low, high = base + self.tree.rank(symbols, low), base + self.tree.rank(symbols, high)
        some = low < high
        return rows[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places, in `stretches`, of the suffixes in these ranks: step back to a kept position."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(rows):
            done = self.kept[rows]
            out[at[done]] = self.kept_at[self.kept_rank[rows[done]]] + steps
            rows, at = rows[~done], at[~done]
            symbols = self.bwt[rows]
            rows = self.first[symbols] + self.tree.rank(symbols, rows)
            steps += 1
        return self.source[out]


def occurrences(words, found: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and pattern of every occurrence in the words of a shard."""
    none = np.zeros(0, np.int64)
    if not len(words.keys) or not len(found.vocabulary):
        return none, none, none
    at = np.minimum(np.searchsorted(found.vocabulary, words.keys), len(found.vocabulary) - 1)
    symbols = np.where(found.vocabulary[at] == words.keys, at + 1, 0)
    # Only stretches of benchmark words that are long enough can hold an occurrence; these are indexed.
    edge = np.zeros(len(symbols) + 1, bool)
    edge[words.first] = True
    known = symbols > 0
    starts = known.copy()
    starts[1:] &= ~known[:-1] | edge[1:-1]
    ends = known.copy()
    ends[:-1] &= ~known[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = ends - starts >= found.shortest
    starts, lengths = starts[long], (ends - starts)[long]
    if not len(starts):
        return none, none, none
    place = ragged(starts, lengths)
    index = FMIndex(symbols[place], np.concatenate([[0], np.cumsum(lengths)]), len(found.vocabulary))
    out, before = [], 0
    for windows in found.windows:
        rows, low, high = index.search(windows)
        hits = index.locate(ragged(low, high - low))
        out.append((place[hits], np.full(len(hits), windows.shape[1]), np.repeat(rows + before, high - low)))
        before += len(windows)
    return tuple(flat([x[k] for x in out], np.int64) for k in range(3))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch], text_col: str, found: Patterns, at: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text_col, SHARD_BYTES):
            words = split_words(part.column(text_col), BREAKS, FOLD)
            start, length, pattern = occurrences(words, found)
            doc = np.searchsorted(words.first, start, side="right") - 1
            spans = [[] for _ in range(part.num_rows)]
            items: list[set] = [set() for _ in range(part.num_rows)]
            for d, s, n, p in zip(doc.tolist(), (start - words.first[doc]).tolist(), length.tolist(), pattern.tolist()):
                spans[d].append((s, s + n))
                items[d].update(found.items[p])
            if at[1] in part.schema.names:  # results of earlier blocks of items
                for d, (old, ids) in enumerate(zip(part.column(at[1]).to_pylist(), part.column(at[2]).to_pylist())):
                    spans[d] += [(x["start"], x["end"]) for x in old]
                    items[d].update(ids)
            part = part.select([c for c in part.schema.names if c not in at])
            values = [
                pa.array(words.counts(), pa.int64()),
                pa.array(map(_merged, spans), SPANS),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, *values], [*part.schema.names, *at])


def find_passages(
    docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW,
    prefix: str = "bench_",
) -> DataFrame:
    """Add each text's words, the spans of words inside benchmark windows, and the items found.

    Words are compared lower-cased in ASCII. Each task cuts its documents into
    shards and indexes every stretch of benchmark words (words of no item only
    separate stretches); all windows of the benchmark are searched backwards at
    once. Nothing is shuffled. The benchmark is read in blocks of at most
    `PATTERN_WORDS` words, so what an executor holds does not grow with it; for
    each further block the documents are written and passed over again.

    Adds `<prefix>n_words`, `<prefix>spans` (merged, in words, end excluded) and
    `<prefix>item_ids` (as strings, sorted). All columns of `docs` stay. A null
    or empty text has no words and no spans; items without words or with null
    text have no window; equal items are all named; repeated rows stay. A null
    item id counts for spans but is not named.
    """
    at = [f"{prefix}{x}" for x in ("n_words", "spans", "item_ids")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += f", `{at[0]}` long, `{at[1]}` array<struct<start: long, end: long>>, `{at[2]}` array<string>"
    sc = docs.sparkSession.sparkContext
    first, rows, held = True, [], 0

    def step(docs: DataFrame, rows: list) -> DataFrame:
        sent = sc.broadcast(patterns(rows, window))
        return docs.mapInArrow(lambda batches: _search(batches, text_col, sent.value, at), schema)

    names = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    for row in names.toLocalIterator():
        size = len(row.text or "") // 2 + 1
        if rows and held + size > PATTERN_WORDS:
            docs = written(step(docs, rows), "passages")
            rows, held, first = [], 0, False
        rows.append((row.item, row.text))
        held += size
    return step(docs, rows) if rows or first else docs


def hit_words(prefix: str = "bench_"):
    """Number of words inside the spans."""
    return F.aggregate(f"{prefix}spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(prefix: str = "bench_"):
    """A twentieth of the words or more are benchmark words."""
    hit = hit_words(prefix)
    return (hit > 0) & (20 * hit >= F.col(f"{prefix}n_words"))
