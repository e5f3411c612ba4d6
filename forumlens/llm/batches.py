"""Words of whole Arrow text batches as numpy arrays: borders, 64-bit keys and n-gram keys.

All arithmetic is modulo 2**64 on prefix sums of a polynomial, so a key of any
span (bytes of a word, words of a shingle) is a difference of two prefixes. Keys
are the same in every task and session. Two different words or spans share a
key with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
MASK = (1 << 64) - 1
BLOCK_BYTES = 1 << 19  # text worked on at a time; bounds the temporary arrays

_draw = np.random.default_rng(20_240_101)
BYTE_KEYS = _draw.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.empty(n, U64)
        out[0] = 1
        done = 1
        while done < n:  # the known powers times the next one, twice as many each time
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        return out

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (n // (1 << 18) + 1) << 18
            self.up, self.down = self._series(self.base, size), self._series(self.inverse, size)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit keys over all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of some texts: byte borders in `data`, keys, and each text's range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    first: np.ndarray  # words of text i are first[i] to first[i + 1]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and key of every run of `n` words inside one text."""
        return grams(self.keys, self.first, n)


def grams(keys: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = len(keys)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = WORD_POWERS.upto(total + 1)
    sums = np.zeros(total + 1, U64)
    np.cumsum(keys * up[:total], out=sums[1:])
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n, total + n) <= ends)
    return at, mix((sums[at + n] - sums[at]) * down[at])


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n, shift = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + shift)[shift:] if n else np.zeros(1, np.int64)
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1])[offsets[0] :]
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, breaks: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not `breaks`, after `fold`, inside each text."""
    data, offsets = utf8(texts)
    if fold is not None:
        data = fold[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(starts)
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(ends) + 1
    up, down = BYTE_POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
    keys = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(data, starts, ends, keys, np.searchsorted(starts, offsets))


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `limit` bytes of text, one row at least."""
    size = np.frombuffer(batch.column(column).cast(pa.large_string()).fill_null("").buffers()[1] or b"\0" * 8, np.int64)
    at, n = 0, batch.num_rows
    size = size[-(n + 1) :] if len(size) > n else np.zeros(n + 1, np.int64)
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, next to other workers."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse_clash(df: DataFrame, names: list[str]) -> None:
    """An error if the table has columns of the names of results: neither may be lost without a word."""
    if clash := sorted(set(names) & set(df.columns)):
        raise ValueError(f"the table has columns named like results: {', '.join(clash)}; rename them or choose another prefix")


def id_hash(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def flat(values: list, kind) -> np.ndarray:
    return np.concatenate(values) if values else np.zeros(0, kind)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 of all i in order."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


def as_binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
