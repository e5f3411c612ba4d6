"""Documents in compressed blocks, and 64-bit keys exchanged between blocks as packed arrays.

A block is a run of whole documents with about `BLOCK_BYTES` of text. What a
block needs to know about the rest of the corpus is asked by key: it sends its
distinct keys, dealt over parts by value, and each part answers every block with
those of its keys that occur elsewhere too. However often a key occurs, a block
sends it once, so frequent keys do not gather in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from forumlens.llm.batches import U64, as_binary, give_back, mix, slices
from forumlens.session import written

BLOCK_BYTES = 1 << 20
BLOCKS_A_PART = 8  # parts follow the number of blocks, so that a part's size does not grow with the corpus
ASKED = "part int, block long, keys binary, many binary"
ANSWERED = "block long, keys binary"


def to_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write all columns of the documents as blocks: `block` and a compressed Arrow `payload`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, options = TaskContext.get().partitionId() << 32, pa.ipc.IpcWriteOptions(compression="zstd")
        held, size = [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held))
            payload = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), payload], ["block", "payload"])

        for batch in batches:
            for part in slices(batch, text_col, block_bytes):
                more = part.nbytes
                if held and size + more > block_bytes:
                    yield packed()
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += more
        if held:
            yield packed()

    return written(docs.mapInArrow(run, "block long, payload binary"), "blocks")


def opened(payload: bytes) -> pa.RecordBatch:
    """The documents of a block, as one batch."""
    rows = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], rows.schema)


def number_of_parts(blocks: DataFrame) -> int:
    return blocks.count() // BLOCKS_A_PART + 1


def asked(block: int, keys: np.ndarray, many: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows that ask for distinct `keys`; `many` marks those that the block holds twice or more itself."""
    part = (mix(keys ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    keys, many, part = keys[order], many[order], part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    to = np.append(at[1:], len(part))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[at], pa.int32()),
            pa.array(np.full(len(at), block), pa.int64()),
            pa.array([as_binary(keys[a:b]) for a, b in zip(at, to)], pa.binary()),
            pa.array([as_binary(many[a:b].astype(np.uint8)) for a, b in zip(at, to)], pa.binary()),
        ],
        ["part", "block", "keys", "many"],
    )


def _repeated(rows: pa.Table) -> pa.Table:
    sent = [np.frombuffer(x, U64) for x in rows.column("keys").to_pylist()]
    keys = np.concatenate(sent)
    many = np.frombuffer(b"".join(rows.column("many").to_pylist()), np.uint8) > 0
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    again = many.copy()
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    # a key that one block marks is in its answer; the other blocks that sent it are equal neighbours
    ends = np.cumsum([len(x) for x in sent])
    kept = [as_binary(x[again[e - len(x) : e]]) for x, e in zip(sent, ends)]
    return pa.table({"block": rows.column("block"), "keys": pa.array(kept, pa.binary())})


def answers(questions: DataFrame) -> DataFrame:
    """For each block, those of its keys that occur twice or more in the corpus (in any order, over several rows)."""
    return questions.groupBy("part").applyInArrow(_repeated, ANSWERED)


def with_answers(blocks: DataFrame, answered: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Apply `run(block, documents, sorted keys)` to every block; it yields record batches of `schema`."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            keys = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in right.column("keys").to_pylist())])
            keys.sort()
            out += list(run(block, opened(payload), keys))
        give_back()
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(both, schema)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
