"""Document fingerprints from prefix polynomial hashes, and each document against its next in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import U64, mix

SPAN = 16  # bytes
KEPT = 48  # least span keys in a fingerprint
KEY_BITS = 40
MODULI = (2_147_483_647, 2_147_483_629)  # primes below 2**31: products of two residues fit 64 bits
BASES = (911_382_323, 972_663_749)
BLOCK_BYTES = 1 << 20
BUCKETS_A_PARTITION = 4


class _Series:
    """Powers of a base and of its inverse modulo a prime."""

    def __init__(self, base: int, modulus: int):
        self.modulus, self.bases = modulus, (base, pow(base, -1, modulus))
        self.made = [np.ones(1, U64), np.ones(1, U64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.made[0]) < n:
            size = 1 << int(n).bit_length()
            for k, base in enumerate(self.bases):
                out = np.ones(size, U64)
                done = 1
                while done < size:
                    out[done : 2 * done] = out[:done] * U64(pow(base, done, self.modulus)) % U64(self.modulus)
                    done *= 2
                self.made[k] = out
        return [x[:n] for x in self.made]


_series = [_Series(b, m) for b, m in zip(BASES, MODULI)]


class Prefixes:
    """Prefix hashes of some byte strings in a row; any span's key takes two look-ups."""

    def __init__(self, texts: list[bytes]):
        self.begin = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8).astype(U64) + U64(1)
        self.sums, self.down = [], []
        for series, modulus in zip(_series, MODULI):
            up, down = series.upto(len(data) + 1)
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(data * up[: len(data)] % U64(modulus), out=sums[1:])
            self.sums.append(sums % U64(modulus))
            self.down.append(down)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit keys of spans: equal for equal bytes, wherever they stand."""
        key = None
        for sums, down, modulus in zip(self.sums, self.down, MODULI):
            part = (sums[end] + U64(modulus) - sums[start]) * down[start] % U64(modulus)
            key = part if key is None else (key << U64(31)) | part
        return key

    def common_extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest equal spans from places a and b, at most `most`: binary search by span equality."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.span(a, a + middle) == self.span(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def sketches(prefixes: Prefixes, span: int = SPAN, kept: int = KEPT) -> list[np.ndarray]:
    """Least keys of each text's spans; a text shorter than a span is one span.

    The second, third and further occurrence of a span in a text are spans of
    their own, so that a text's repeated parts weigh as much as its other parts.
    """
    sizes = np.diff(prefixes.begin)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - span + 1, 1))
    first = np.cumsum(counts) - counts
    start = np.arange(counts.sum()) + np.repeat(prefixes.begin[:-1] - first, counts)
    keys = mix(prefixes.span(start, start + np.repeat(np.minimum(sizes, span), counts)))
    out = []
    for a, n in zip(first.tolist(), counts.tolist()):
        own = np.sort(keys[a : a + n])
        again = np.flatnonzero(own[1:] == own[:-1]) + 1
        if len(again):
            new = np.ones(n, bool)
            new[again] = False
            at = np.arange(n)
            number = (at - np.maximum.accumulate(np.where(new, at, 0)))[again]
            own[again] = mix(own[again] + number.astype(U64) * U64(0x9E3779B97F4A7C15))
            own.sort()
        out.append(np.unique(own[: 2 * kept] >> U64(64 - KEY_BITS))[:kept])
    return out


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of spans that two texts have in common (Dice), estimated from their least keys."""
    if not len(a) and not len(b):
        return 1.0
    least = np.union1d(a, b)[:kept]
    common = np.isin(least, a, assume_unique=True) & np.isin(least, b, assume_unique=True)
    jaccard = common.mean()
    return float(2 * jaccard / (1 + jaccard))


def written_out(key: int, sketch: np.ndarray) -> str:
    """Key of the whole text and its least span keys, in hexadecimal."""
    return f"{key:016x}:" + "".join(f"{x:010x}" for x in sketch.tolist())


FIELDS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_bytes long"
)


def _rows(ids: list, texts: list[str], following: list[str]) -> Iterator[tuple]:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
    n = len(texts)
    # texts, edited texts, then the texts that follow and are not in this block
    own = [x.encode("utf-8", "surrogatepass") for x in (*texts, *edited, following[-1])]
    prefixes = Prefixes(own)
    begin, size = prefixes.begin[:-1], np.diff(prefixes.begin)
    keys = prefixes.span(begin, begin + size).tolist()
    found = sketches(prefixes)
    common = prefixes.common_extension(begin[:n], begin[n : 2 * n], np.minimum(size[:n], size[n : 2 * n])).tolist()
    for i in range(n):
        # the next row of the block is the next document, or the extra text at the end is
        after = i + 1 if i + 1 < n and following[i] is texts[i + 1] else None
        if after is None:
            after = 2 * n if i == n - 1 else None
        nearby = found[after] if after is not None else sketches(Prefixes([following[i].encode("utf-8", "surrogatepass")]))[0]
        yield (
            ids[i], len(texts[i]), hashlib.sha256(own[n + i]).hexdigest(), written_out(keys[i], found[i]),
            written_out(keys[n + i], found[n + i]), likeness(found[i], found[n + i]), likeness(found[i], nearby), common[i],
        )


def _batch(rows: list[tuple], id_col: str, kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64()]
    names = [id_col, *(f.split()[0] for f in FIELDS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows by ascending id (ties by text, null ids last) in sorted partitions, cut into buckets of ids.

    Each bucket ends with a copy (`tail`) of the row that follows it in the next
    bucket; the last bucket's is the very first row. Bounds and first ids come
    to the driver: a few numbers for each shuffle partition.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS_A_PARTITION
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.percentile_approx("id", [k / buckets for k in range(1, buckets)], 10 * buckets)
    bounds = rows.select(F.col("id").cast("double").alias("id")).agg(at.alias("b")).first()["b"] or []
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep")
    rows = cut.transform(rows.withColumn("at", F.col("id").cast("double")))
    rows = rows.select("id", "text", F.coalesce(F.col("bucket").cast("int"), F.lit(len(splits))).alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("id").alias("id")).collect()
    firsts = sorted(((r["bucket"], r["id"]) for r in least), key=lambda first: first[0])
    tails = [(firsts[(k + 1) % len(firsts)][1], b) for k, (b, _) in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    ends = spark.createDataFrame(tails, f"first_id {kind}, ends int") if tails else None
    marked = rows.withColumn("tail", F.lit(0))
    if ends is not None:
        copies = rows.join(F.broadcast(ends), rows["id"].eqNullSafe(ends["first_id"]))
        marked = marked.union(copies.select("id", "text", F.col("ends").alias("bucket"), F.lit(1).alias("tail")))
    order = ["bucket", "tail", F.col("id").asc_nulls_last(), "text"]
    return marked.repartition(partitions, "bucket").sortWithinPartitions(*order)


def fingerprint_neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text replaces the last half (rounded down, in code points) by as
    many code points of the next document by ascending id; after the last comes
    the first. Rows travel once, in ranges of ids; each is fingerprinted with
    prefix hashes over blocks of texts. `common_bytes` is the longest common
    extension from the start of the text and the edited text.

    A null text is empty: its fingerprint has no span keys, and two empty texts
    are alike. Repeated ids are ordered by text; a single document follows
    itself. An empty table gives no row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, kind = [], 0, None, pa.int64()

        def done():
            rows = list(_rows([h[0] for h in held], [h[1] for h in held], [h[2] for h in held]))
            return _batch(rows, id_col, kind)

        for batch in batches:
            kind = batch.schema.field("id").type
            columns = [batch.column(c) for c in ("bucket", "tail", "id", "text")]
            for bucket, tail, doc, text in zip(*(c.to_pylist() for c in columns)):
                if last is not None and last[0] == bucket:
                    held.append((last[1], last[2], text))
                    size += len(last[2])
                    if size > BLOCK_BYTES:
                        yield done()
                        held, size = [], 0
                last = None if tail else (bucket, doc, text)
        if held:
            yield done()

    kind = docs.schema[id_col].dataType.simpleString()
    return in_order(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
