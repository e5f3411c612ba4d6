"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read from sorted hash arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import FOLD, U64, Words, as_binary, flat, mix, slices, split_words
from forumlens.session import new_path

END = int(mix(np.array([0xE0D], U64))[0])  # key of the token that ends every text
CHARS_A_PART = 8 << 20  # parts follow the text, so that a part's size does not grow with the corpus
HELD = 4_000_000  # counts a task gathers before it puts equal keys together
MARK = "mounted"  # a file that every machine has to see
FULL = 255  # counts from here on are kept beside the one-byte array
COUNTED = "part long, kind int, ones binary, keys binary, counts binary"


def _local(path: str) -> str:
    """The shared folder as a path that workers can map; it has to be mounted on all machines."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped into memory: spark.checkpoint.dir must be a mounted folder, not {path}")
    return url.path


def _put(path: str, values: np.ndarray) -> None:
    """Write an array so that it is there whole or not at all; a task that runs again writes the same."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(as_binary(values))
    os.replace(part, path)


def _get(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class Counter:
    """Counts of 64-bit keys in a task, in bounded memory between two calls of `rows`."""

    def __init__(self):
        self.keys, self.counts, self.fresh = np.zeros(0, U64), np.zeros(0, np.int64), []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        """True when it is time to give the counts out."""
        self.fresh.append(keys)
        self.held += len(keys)
        if self.held > HELD:
            self._gather()
        return len(self.keys) > HELD

    def _gather(self) -> None:
        new, counts = np.unique(flat(self.fresh, U64), return_counts=True)
        self.keys, self.counts = _summed(np.concatenate([self.keys, new]), np.concatenate([self.counts, counts]))
        self.fresh, self.held = [], 0

    def rows(self, part_of) -> Iterator[pa.RecordBatch]:
        self._gather()
        part = part_of(self.keys)
        yield _counted(part, np.zeros(len(part), np.int32), self.keys, self.counts)
        self.__init__()


def _counted(part: np.ndarray, kind: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each (part, kind): keys counted once in `ones`, others with their counts."""
    order = np.lexsort((kind, part))
    part, kind, keys, counts = part[order].astype(np.int64), kind[order].astype(np.int32), keys[order], counts[order]
    new = (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])
    at = np.flatnonzero(np.concatenate([[True], new])) if len(part) else np.zeros(0, np.int64)
    cells = [[], [], []]
    for a, b in zip(at, np.append(at[1:], len(part))):
        one = counts[a:b] == 1
        for cell, values in zip(cells, (keys[a:b][one], keys[a:b][~one], counts[a:b][~one].astype(np.int64))):
            cell.append(as_binary(values))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[at]), pa.array(kind[at]), *(pa.array(c, pa.binary()) for c in cells)],
        ["part", "kind", "ones", "keys", "counts"],
    )


def _received(rows: pa.Table, kind=U64) -> tuple[np.ndarray, np.ndarray]:
    ones, keys, counts = (
        flat([np.frombuffer(x, k) for x in rows.column(c).to_pylist()], k)
        for c, k in (("ones", kind), ("keys", kind), ("counts", np.int64))
    )
    return _summed(np.concatenate([ones, keys]), np.concatenate([np.ones(len(ones), np.int64), counts]))


def discounts(n: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of items seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.01), k - 0.01) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all workers need."""

    folder: str
    parts: int  # a power of two; the first bits of a key are its part
    offsets: list[int] = field(default_factory=list)  # number of the first word of each part
    sizes: list[int] = field(default_factory=list)  # words of each part
    words: int = 0
    tokens: int = 0
    texts: int = 0
    span: int = 1  # word numbers in a part of the context arrays
    high: list[float] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    types: int = 0
    spread: float = 0.0  # what the discounts take from all words, for words not seen

    @property
    def shift(self) -> int:
        return 64 - (self.parts.bit_length() - 1)

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(self.shift)).astype(np.int64) if self.parts > 1 else np.zeros(len(keys), np.int64)

    @property
    def start(self) -> int:
        """Number of what stands before a text."""
        return self.words


class Reader:
    """A worker's view of the arrays: files are mapped, not read."""

    def __init__(self, model: Model):
        if not os.path.exists(f"{model.folder}/{MARK}"):
            raise FileNotFoundError(f"the model's folder {model.folder} is not there; spark.checkpoint.dir has to be mounted on every machine")
        self.model, self.maps = model, {}

    def _array(self, name: str, kind) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = _get(f"{self.model.folder}/{name}", kind)
        return self.maps[name]

    def _find(self, table: str, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """Sorted keys by part: part, their slice, which are there, and where."""
        part = self.model.part(keys)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(at.tolist(), np.append(at[1:], len(part)).tolist()):
            there = self._array(f"{table}-{part[a]}.keys", U64)
            if table == "words" and len(there) != self.model.sizes[part[a]]:
                raise FileNotFoundError(f"part {part[a]} of the words in {self.model.folder} is not complete")
            if len(there):
                place = np.minimum(np.searchsorted(there, keys[a:b]), len(there) - 1)
                yield int(part[a]), slice(a, b), there[place] == keys[a:b], place

    def word_numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and training count of each word key."""
        keys, back = np.unique(keys, return_inverse=True)
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for part, at, known, place in self._find("words", keys):
            number[at] = np.where(known, place + self.model.offsets[part], -1)
            count[at] = np.where(known, self._array(f"words-{part}.counts", np.int64)[place], 0)
        return number[back], count[back]

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        keys, back = np.unique(mix(pairs), return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        for part, at, known, place in self._find("pairs", keys):
            count = self._array(f"pairs-{part}.counts", np.uint8)[place].astype(np.int64)
            if (large := np.flatnonzero(known & (count == FULL))).size:
                over = self._array(f"pairs-{part}.over", np.int64).reshape(2, -1)
                count[large] = over[1][np.searchsorted(over[0], place[large])]
            out[at] = np.where(known, count, 0)
        return out[back]

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """For each word number: words that follow it once, twice, more often; words it follows."""
        unique, back = np.unique(numbers, return_inverse=True)
        out = np.zeros((len(unique), 4), np.int64)
        part = unique // self.model.span
        for p in np.unique(part):
            some = part == p
            made = self._array(f"contexts-{p}", np.int32)
            if len(made):
                out[some] = made.reshape(-1, 4)[unique[some] - p * self.model.span]
        return out[back]


_readers: dict[str, Reader] = {}


def reader(model: Model, stage: str = "") -> Reader:
    """The worker's reader of a model; only the newest is kept. `stage`: arrays are added as counting goes on."""
    key = f"{model.folder}/{stage}"
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(model)
    return _readers[key]


def tokens(words: Words, numbers: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens with each text's end, of what precedes each, and each text's first token."""
    texts = len(words.first) - 1
    first = words.first[:-1] + np.arange(texts)
    token = np.full(len(numbers) + texts, end, np.int64)
    inner = np.arange(len(numbers)) + np.repeat(np.arange(texts), words.counts())
    token[inner] = numbers
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = start
    return token, before, first


def _mapped(docs: DataFrame, text_col: str, run) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, part_of = Counter(), None
        for batch in batches:
            for part in slices(batch, text_col):
                keys, part_of = run(split_words(part.column(text_col), fold=FOLD))
                if counter.add(keys):
                    yield from counter.rows(part_of)
        if part_of is not None:
            yield from counter.rows(part_of)

    return docs.select(text_col).mapInArrow(over, COUNTED)


def fit(docs: DataFrame, text_col: str) -> Model:
    """Count the model of all texts of `docs`: words (runs without ASCII white space, lower-cased) and an end.

    Tasks count keys in memory and deal distinct ones out over parts by hash, so
    a frequent word or pair is one entry of each task, never a gathered group.
    Parts are written as sorted arrays to the shared folder of the cluster,
    under final names only once complete. To the driver come a few numbers of
    each part. Everything is counted, words seen once included.
    """
    chars = docs.select(F.sum(F.length(text_col)), F.count("*")).first()
    parts = 1 << max(0, int((chars[0] or 0) // CHARS_A_PART).bit_length())
    folder = _local(new_path(docs.sparkSession, "language-model"))
    os.makedirs(folder, exist_ok=True)
    _put(f"{folder}/{MARK}", np.ones(1))
    model = Model(folder, parts, texts=chars[1])

    def word_keys(words: Words):
        return np.concatenate([words.keys, np.full(len(words.first) - 1, END, U64)]), model.part

    def keep_words(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        keys, counts = _received(rows)
        _put(f"{folder}/words-{part}.counts", counts)
        _put(f"{folder}/words-{part}.keys", keys)
        return pa.table({"part": [part], "words": [len(keys)], "tokens": [int(counts.sum())]})

    made = _mapped(docs, text_col, word_keys).groupBy("part").applyInArrow(keep_words, "part long, words long, tokens long").collect()
    sizes = {r.part: r.words for r in made}
    model.words, model.tokens = sum(sizes.values()), sum(r.tokens for r in made)
    model.sizes = [sizes.get(p, 0) for p in range(parts)]
    model.offsets = np.cumsum([0, *model.sizes[:-1]]).tolist()
    model.span = (model.words + 1) // parts + 1
    if not model.words:
        return model

    def pair_keys(words: Words):
        known = reader(model, "words")
        numbers, _ = known.word_numbers(words.keys)
        end = int(known.word_numbers(np.array([END], U64))[0][0])
        token, before, _ = tokens(words, numbers, end, model.start)
        return before.astype(U64) << U64(32) | token.astype(U64), lambda pairs: model.part(mix(pairs))

    def keep_pairs(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        pairs, counts = _received(rows)
        keys = mix(pairs)
        order = np.argsort(keys)
        sorted_counts = counts[order]
        over = np.flatnonzero(sorted_counts >= FULL)
        _put(f"{folder}/pairs-{part}.over", np.concatenate([over, sorted_counts[over]]))
        _put(f"{folder}/pairs-{part}.counts", np.minimum(sorted_counts, FULL).astype(np.uint8))
        _put(f"{folder}/pairs-{part}.keys", keys[order])
        # to the contexts: once for the word before, by how often the pair was seen, and once for the word itself
        before, word = (pairs >> U64(32)).astype(np.uint32), pairs.astype(np.uint32)
        number = np.concatenate([before, word])
        kind = np.concatenate([np.minimum(counts, 3) - 1, np.full(len(word), 3)])
        to, inside = number // np.uint32(model.span), number % np.uint32(model.span)
        ones = np.ones(len(number), np.int64)
        sums = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
        head = _counted(np.full(4, -1), np.arange(4), np.zeros(4, np.uint32), sums + 2)  # never 1: all with counts
        return pa.Table.from_batches([head, _counted(to, kind, inside, ones)])

    def keep_contexts(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        kinds = rows.column("kind").to_pylist()
        if part < 0:  # how many pairs were seen 1, 2, 3 and 4 times
            sums = [0] * 4
            for kind, counts in zip(kinds, rows.column("counts").to_pylist()):
                sums[kind] += int(np.frombuffer(counts, np.int64)[0]) - 2
            return pa.table({"part": [part], "n": [sums], "types": [0]})
        made = np.zeros((model.span, 4), np.int32)
        for kind, ones in zip(kinds, rows.column("ones").to_pylist()):
            made[:, kind] += np.bincount(np.frombuffer(ones, np.uint32), minlength=model.span).astype(np.int32)
        _put(f"{folder}/contexts-{part}", made)
        follows = made[:, 3]
        n = np.bincount(np.minimum(follows, 5), minlength=6)[1:]
        return pa.table({"part": [part], "n": [n.tolist()], "types": [int(follows.sum())]})

    dealt = _mapped(docs, text_col, pair_keys).groupBy("part").applyInArrow(keep_pairs, COUNTED)
    made = dealt.groupBy("part").applyInArrow(keep_contexts, "part long, n array<long>, types long").collect()
    model.high = discounts(next(r.n for r in made if r.part < 0))
    seen = np.sum([r.n for r in made if r.part >= 0], axis=0).tolist()
    model.types = sum(r.types for r in made)
    model.low = discounts(seen[:4])
    model.spread = (model.low[0] * seen[0] + model.low[1] * seen[1] + model.low[2] * sum(seen[2:])) / model.types
    return model


def _discount(counts: np.ndarray, by: list[float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3)]


def log_probabilities(model: Model, words: Words) -> tuple[np.ndarray, ...]:
    """For each text: tokens, tokens seen in training, add-half log10 score, and the model's log10 score."""
    known = reader(model, "all")
    numbers, _ = known.word_numbers(words.keys)
    end = int(known.word_numbers(np.array([END], U64))[0][0])
    token, before, first = tokens(words, numbers, end, model.start)
    keys, _, _ = tokens(words, words.keys.view(np.int64), int(np.array([END], U64).view(np.int64)[0]), 0)
    _, count = known.word_numbers(keys.view(U64))
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    if model.words:
        there = known.contexts(np.maximum(token, 0))[:, 3] * (token >= 0)
        low = np.maximum(there - _discount(there, model.low), 0) / model.types + model.spread / (model.words + 1)
        # times each context was seen: for a word its count, for the start the number of texts
        context = np.maximum(before, 0)
        total = np.where(before == model.start, model.texts, np.concatenate([[0], count[:-1]]))
        split = known.contexts(context)[:, :3]
        some = before >= 0
        both = some & (token >= 0)
        pair = np.zeros(len(token), np.int64)
        pair[both] = known.pair_counts(before[both].astype(U64) << U64(32) | token[both].astype(U64))
        total = np.maximum(total, 1)
        left = split @ np.array(model.high) / total
        high = np.maximum(pair - _discount(pair, model.high), 0) / total
        score = np.log10(np.where(some, high + left * low, low))
    else:
        score = np.zeros(len(token))
    sums = [np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in ((count > 0).astype(np.int64), base, score)]
    return words.counts() + 1, *sums


def score(docs: DataFrame, text_col: str, model: Model, prefix: str = "lm_") -> DataFrame:
    """Add `<prefix>tokens`, `<prefix>known`, `<prefix>base_score`, `<prefix>score` and `<prefix>perplexity`.

    Workers map the model's arrays; a block's distinct words and pairs are looked
    up in order, each part of the model in one sweep. A null or empty text is its
    end token alone. Unknown words share what the discounts leave for them. With
    an empty training table every score is 0. All columns and rows stay.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = [f"{prefix}{x}" for x in ("tokens", "known", "base_score", "score", "perplexity")]
    kinds = ["long", "long", "double", "double", "double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                n, seen, base, own = log_probabilities(model, split_words(part.column(text_col), fold=FOLD))
                values = [n, seen, base, own, 10 ** (-own / n)]
                types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                more = [pa.array(v, t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema + "".join(f", `{n}` {k}" for n, k in zip(names, kinds)))


def train_tokens(model: Model) -> Column:
    return F.lit(model.tokens).cast("long")
