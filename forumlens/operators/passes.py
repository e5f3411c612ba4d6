"""Passes of iterative methods over rows that tasks hold as packed arrays.

An iterative fit goes over the same rows many times with little new each time.
The rows are packed once into blocks of numpy arrays, which executors keep; a
pass is one function over a partition's blocks, and its arrays are added up in
slabs by the executors. Blocks of a lost executor are read again from the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from forumlens.session import written

MATRIX = "cells binary, width long"
DRIVER_BYTES = 32 << 20  # of the arrays of all partitions that the driver adds up itself
SLAB_BYTES = 8 << 20  # of an array that executors add up at a time


def held(blocks: DataFrame) -> RDD:
    """Blocks, rows of binary and plain columns, kept by the executors as tuples."""
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def summed(blocks: RDD, of_partition: Callable[[Iterator[tuple]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all partitions of an array of the given shape.

    Arrays that take no more than `DRIVER_BYTES` together are added up by the
    driver, in the order of the partitions. Others are cut into slabs of rows
    that executors add up, and the driver takes one partition of whole sums
    after the other: it holds the result and some slabs, whatever the number of tasks.
    """
    size, tasks = 8 * int(np.prod(shape)), blocks.getNumPartitions()
    if tasks * size <= DRIVER_BYTES:

        def run(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            yield of_partition(rows)

        return reduce(_added, blocks.mapPartitions(run).collect(), np.zeros(shape))
    step = max(1, SLAB_BYTES * shape[0] // size)
    slabs = -(-shape[0] // step)

    def cut(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        whole = of_partition(rows)
        for i in range(slabs):
            yield i, whole[i * step : (i + 1) * step]

    out = np.zeros(shape)
    for i, part in blocks.mapPartitions(cut).reduceByKey(_added, slabs).toLocalIterator():
        out[i * step : (i + 1) * step] = part
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a if a.flags.writeable else a.copy()
    a += b
    return a


def held_matrix(features: DataFrame, array: str, least_rows: int = 0) -> RDD:
    """Arrays of one length as blocks (cells, width) of a matrix, one for each batch of rows.

    Small partitions are joined until they have about `least_rows` rows, so
    that what a task sends is not much more than what it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.asarray(batch.column(0).flatten(), "<f8")
                arrays = [pa.array([cells.tobytes()], pa.binary()), pa.array([len(cells) // batch.num_rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["cells", "width"])

    blocks = written(features.select(array).mapInArrow(run, MATRIX), "matrix")
    if least_rows:
        most = max(1, features.count() // least_rows)
        blocks = blocks.coalesce(min(most, blocks.rdd.getNumPartitions()))
    return held(blocks)


def matrices(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
    for cells, width in rows:
        yield np.frombuffer(cells, "<f8").reshape(-1, width)
