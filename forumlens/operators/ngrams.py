"""Which n-grams separate two classes: counts, Fisher's exact test, selections."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from forumlens.functions import text as T

# Fixed value: relative slack when comparing table probabilities.
SLACK = 1e-7
RARE = 200
_TAIL_STOP = 1e-17
_BLOCK = 64
SLICE_WORDS = 1 << 19  # words of some rows that are counted at a time
BUCKETS = 1024  # groups of n-grams that are added up, at least; a task holds one at a time
MOST_BUCKETS = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = pa.schema([("term", pa.string()), ("y", pa.int32()), ("tf", pa.int64()), ("df", pa.int64())])
CLASS_COUNTS = ["0_total_freq", "0_doc_freq", "1_total_freq", "1_doc_freq"]
_SMALL = np.array([math.lgamma(k + 1) for k in range(32)])

# The helpers below travel to the executors with the UDF that calls them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _grams(rows: pa.RecordBatch, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..longest: (n-grams, a row of each one's label, occurrences, documents, hash) of some rows (words, label)."""
    lists = rows.column(0)
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    words = lists.flatten().dictionary_encode()
    code, terms = np.asarray(words.indices, np.int64), words.dictionary
    doc, left = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
    label = np.asarray(rows.column(1).dictionary_encode(null_encoding="encode").indices, np.int64)
    labels, of_label = np.unique(label, return_index=True)
    label = np.searchsorted(labels, label)
    doc_bits, label_bits = len(lengths).bit_length(), len(labels).bit_length()
    hashes = pd.util.hash_array(terms.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)
    key = code
    for n in range(1, longest + 1):
        if n > 1:  # runs of n words that end inside the row
            key = key[: len(code) - n + 1] * len(terms) + code[n - 1 :]
        some = np.flatnonzero(left[: len(key)] >= n)
        if not len(some):
            return
        gram = pd.factorize(key[some])[0]  # numbered anew in order of appearance, so that keys of any length fit
        first = np.flatnonzero(np.diff(np.maximum.accumulate(gram), prepend=-1))
        key = np.zeros(len(key), np.int64)
        key[some] = gram
        pair, tf = np.unique(gram << doc_bits | doc[some], return_counts=True)
        cell = pair >> doc_bits << label_bits | label[pair & (1 << doc_bits) - 1]
        df = np.bincount(cell)
        both = np.flatnonzero(df)
        at = some[first[both >> label_bits]]
        parts = [terms.take(pa.array(code[at + j])) for j in range(n)]
        spread = np.zeros(len(at), np.uint64)
        for j in range(n):
            spread = spread * MIX + hashes[code[at + j]]
        spread = (spread ^ (spread >> np.uint64(32))) * MIX >> np.uint64(32)
        found = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", terms.type))
        yield found, of_label[both & (1 << label_bits) - 1], np.bincount(cell, tf)[both].astype(np.int64), df[both], spread


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (words, label) that are counted together."""
    ends = np.cumsum(np.asarray(batch.column(0).value_lengths().fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_WORDS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _counted(rows: pa.RecordBatch, longest: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(term, y, tf, df) of some rows, and a number that spreads each term, the same in every task."""
    for term, row, tf, df, spread in _grams(rows, longest):
        y = rows.column(1).take(pa.array(row))
        arrays = [term.cast(pa.string()), y, pa.array(tf), pa.array(df, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["term", "y", "tf", "df"]), spread


def ngram_counts(docs: DataFrame, longest: int) -> DataFrame:
    """(term, y, tf, df): counts of all runs of 1..longest words over some rows of (words, y) at a time, to be added up.

    A term has one row for each label and slice of rows that it occurs in; null words are no words.
    """
    kind = docs.schema["y"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                for counts, _ in _counted(rows, longest):
                    yield counts

    return docs.select("words", "y").mapInArrow(run, f"term string, y {kind}, tf long, df long")


def _in_buckets(longest: int, buckets: int):
    """Rows (words, y) to (bucket, block): the counts of a slice's n-grams, those of a bucket packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (r for batch in batches for r in _slices(batch)):
            parts = list(_counted(rows, longest))
            if not parts:
                continue
            to = (np.concatenate([spread for _, spread in parts]) % np.uint64(buckets)).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            counts = pa.Table.from_batches([p for p, _ in parts]).cast(COUNTS).take(pa.array(order)).combine_chunks().to_batches()[0]
            found, first = np.unique(to[order], return_index=True)
            ends = [*first[1:], len(order)]
            blocks = [counts.slice(a, b - a).serialize().to_pybytes() for a, b in zip(first, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return run


def _added_up(min_df: int):
    """The blocks of a bucket to one row for each n-gram of `min_df` documents or more."""

    def run(part: pa.Table) -> pa.Table:
        blocks = [pa.ipc.read_record_batch(pa.py_buffer(b), COUNTS) for b in part.column("block").to_pylist()]
        counts = pa.Table.from_batches(blocks, COUNTS)
        columns = {"ngram": counts["term"]}
        for name in CLASS_COUNTS:
            own = pc.fill_null(pc.equal(counts["y"], int(name[0])), False)
            columns[name] = pc.if_else(own, counts["tf" if "total" in name else "df"], 0)
        sums = pa.table(columns).group_by("ngram", use_threads=False).aggregate([(c, "sum") for c in CLASS_COUNTS])
        sums = sums.select(["ngram", *(f"{c}_sum" for c in CLASS_COUNTS)]).rename_columns(["ngram", *CLASS_COUNTS])
        return sums.filter(pc.greater_equal(pc.add(sums["0_doc_freq"], sums["1_doc_freq"]), min_df))

    return run


def class_ngrams(docs: DataFrame, text: str, label: str, longest: int = 3, min_df: int = 2) -> DataFrame:
    """Total and document frequency of every n-gram per class.

    Each task counts the n-grams of many documents at a time. Counts travel as
    blocks, one for each bucket of n-grams (by hash), so that the shuffle has few
    rows; a bucket's blocks are added up together. Buckets follow the session's
    number of shuffle partitions.
    """
    spark = docs.sparkSession
    buckets = min(MOST_BUCKETS, max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    y = F.when(F.col(label) == 0, 0).when(F.col(label) == 1, 1).cast("int")
    rows = docs.select(T.tokens(F.col(text)).alias("words"), y.alias("y"))
    blocks = rows.mapInArrow(_in_buckets(longest, buckets), "bucket int, block binary")
    schema = ", ".join(["ngram string", *(f"`{c}` long" for c in CLASS_COUNTS)])
    counted = blocks.groupBy("bucket").applyInArrow(_added_up(min_df), schema)
    return (
        counted.withColumn("n", F.size(F.split("ngram", " ")))
        .withColumn("total_freq", F.col("0_total_freq") + F.col("1_total_freq"))
        .withColumn("doc_freq", F.col("0_doc_freq") + F.col("1_doc_freq"))
        .where(F.col("doc_freq") >= min_df)
    )


def contingency(ngrams: DataFrame, total_pos: Column, total_neg: Column) -> DataFrame:
    """The cells of each n-gram's 2x2 table."""
    return ngrams.withColumns(
        {
            "pos_in": F.col("1_doc_freq"),
            "pos_out": total_pos - F.col("1_doc_freq"),
            "neg_in": F.col("0_doc_freq"),
            "neg_out": total_neg - F.col("0_doc_freq"),
        }
    )


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) of whole numbers: a table for small ones, Stirling's series beyond."""
    n = np.asarray(n, float)
    m = np.maximum(n, 32.0)
    series = m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    return np.where(n < 32, _SMALL[np.minimum(n, 31).astype(int)], series)


def _tails(x, step, pos, neg, drawn) -> np.ndarray:
    """For each table the sum of pmf(x'), in units of pmf(x), over x' = x, x + step, ... to the end of its support.

    Ratios of neighbours are rational in x and zero at the support's end, so a
    block of terms is a cumulative product. All tables go on together until
    their terms have vanished.
    """
    x, total = x.astype(float), np.ones(len(x))
    rows, term = np.arange(len(x)), np.ones(len(x))
    while len(rows):
        at = x[rows, None] + step[rows, None] * np.arange(_BLOCK)
        a, b, d = (v[rows, None].astype(float) for v in (pos, neg, drawn))
        up = (a - at) * (d - at) / (np.maximum(at + 1, 1) * np.maximum(b - d + at + 1, 1))
        down = at * (b - d + at) / (np.maximum(a - at + 1, 1) * np.maximum(d - at + 1, 1))
        terms = term[rows, None] * np.cumprod(np.where(step[rows, None] > 0, up, down), axis=1)
        total[rows] += terms.sum(axis=1)
        term[rows] = terms[:, -1]
        x[rows] += step[rows] * _BLOCK
        rows = rows[np.abs(term[rows]) > _TAIL_STOP * total[rows]]
    return total


def fisher_two_sided(pos_in, neg_in, pos, neg) -> np.ndarray:
    """Two-sided p-values of the tables [[pos_in, pos - pos_in], [neg_in, neg - neg_in]], given as arrays."""
    pos_in, neg_in, pos, neg = (np.atleast_1d(np.asarray(x, np.int64)) for x in (pos_in, neg_in, pos, neg))
    drawn = pos_in + neg_in
    low, high = np.maximum(0, drawn - neg), np.minimum(pos, drawn)
    fixed = _log_factorial(pos) + _log_factorial(neg) - _log_factorial(pos + neg)
    fixed = fixed + _log_factorial(drawn) + _log_factorial(pos + neg - drawn)

    def log_pmf(x: np.ndarray) -> np.ndarray:
        cells = (x, pos - x, drawn - x, neg - drawn + x)
        return fixed - sum(_log_factorial(c) for c in cells)

    seen = log_pmf(pos_in)
    limit = seen + math.log1p(SLACK)
    mode = np.clip((drawn + 1) * (pos + 1) // (pos + neg + 2), low, high)
    step = np.where(pos_in < mode, 1, -1)
    p = np.exp(seen) * _tails(pos_in, -step, pos, neg, drawn)
    # the first value on the other side of the mode that is as improbable, by bisection
    near, far = mode.copy(), np.where(step > 0, high, low)
    other = log_pmf(far) <= limit
    while (open_ := other & (np.abs(far - near) > 1)).any():
        middle = (near + far) // 2
        rare = log_pmf(middle) <= limit
        far = np.where(open_ & rare, middle, far)
        near = np.where(open_ & ~rare, middle, near)
    p += np.where(other, np.exp(log_pmf(far)) * _tails(far, step, pos, neg, drawn), 0.0)
    return np.where(log_pmf(mode) <= limit, 1.0, np.minimum(p, 1.0))


@F.pandas_udf(DoubleType())
def _fisher(pos_in: pd.Series, neg_in: pd.Series, pos: pd.Series, neg: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(pos_in, neg_in, pos, neg), dtype=float)


def with_p_values(ngrams: DataFrame, total_pos: Column, total_neg: Column) -> DataFrame:
    """Attach Fisher's p-value. Pass a table that is cheap to read again.

    It depends on the two document frequencies only, and most n-grams share
    theirs with many others, so it is computed once per distinct pair. Rare
    n-grams crowd on the few smallest pairs: those pairs (at most
    RARE * RARE / 2) are broadcast, all others are joined by shuffle.
    """
    pair = ["1_doc_freq", "0_doc_freq"]
    rare = F.col("1_doc_freq") + F.col("0_doc_freq") <= RARE
    p = _fisher(*[F.col(c) for c in pair], total_pos, total_neg)

    def tested(part: DataFrame) -> DataFrame:
        return part.select(*pair).distinct().withColumn("p_value", p)

    few, many = ngrams.where(rare), ngrams.where(~rare)
    return few.join(F.broadcast(tested(few)), pair).unionByName(many.join(tested(many), pair))


def significant(ngrams: DataFrame, p_value: float = 0.05, longest: int = 3) -> DataFrame:
    """n-grams with p below the limit and the class they speak for: the one
    with more documents; equal counts speak for none and are dropped."""
    pos, neg = F.col("1_doc_freq"), F.col("0_doc_freq")
    return (
        ngrams.where((F.col("p_value") < p_value) & (F.col("n") <= longest) & (pos != neg))
        .withColumn("predicts", F.when(pos > neg, 1).otherwise(0))
    )


def display_weights(sig: DataFrame) -> DataFrame:
    """1 - p of the positive uni- and bigrams."""
    chosen = sig.where((F.col("predicts") == 1) & F.col("n").isin(1, 2))
    return chosen.select("ngram", "n", (1 - F.col("p_value")).alias("weight"), "1_doc_freq")


def exclusive(sig: DataFrame) -> DataFrame:
    """Significant n-grams that never occur in the negative class."""
    return sig.where(F.col("0_doc_freq") == 0).select("n", "ngram", "1_doc_freq")
