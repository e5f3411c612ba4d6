"""Near-duplicate documents by MinHash, banding, verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import FOLD, U64, mix, ragged, slices, split_words
from forumlens.llm.components import components
from forumlens.session import written

BANDS, ROWS = 32, 5
CHUNK = 256  # signatures compared at a time with as many others
CHUNK_KEYS = 1 << 17  # keys of full sets compared at a time with as many others

_draw = np.random.default_rng(6)
SCALE = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
SHIFT = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=U64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct keys of each text's runs of `size` words; of all its words if there are fewer."""
    words = split_words(texts, fold=FOLD)
    at, keys = words.grams(size)
    begin = np.searchsorted(at, words.first)
    counts = words.counts()
    out = [np.unique(keys[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words.keys[words.first[i] : words.first[i + 1]]
        out[i] = mix(np.bitwise_xor.reduce(own * np.arange(3, 2 * len(own) + 3, 2, dtype=U64), keepdims=True))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Least values of universal hashes (multiply, add, keep the high half) over each non-empty set."""
    out = np.empty((len(sets), len(SCALE)), np.uint32)
    at = 0
    while at < len(sets):  # about 16,000 keys at a time stay in the processor's cache
        to, held = at + 1, len(sets[at])
        while to < len(sets) and held + len(sets[to]) <= 16_384:
            held += len(sets[to])
            to += 1
        keys = np.concatenate(sets[at:to])
        begin = np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(len(SCALE)):
            out[at:to, k] = np.minimum.reduceat((keys * SCALE[k] + SHIFT[k]) >> U64(32), begin)
        at = to
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.zeros((len(signatures), BANDS), U64)
    for row in range(ROWS):
        keys = mix(keys * U64(31) + signatures[:, row::ROWS].astype(U64) + U64(row + 1))
    return mix(keys + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(values))


def _node(keys: np.ndarray) -> int:
    """Key of a whole set."""
    x = mix(keys + U64(len(keys)))
    sums = x.sum(dtype=U64, keepdims=True) ^ (mix(x).sum(dtype=U64, keepdims=True) * U64(0x9E3779B97F4A7C15))
    return int(mix(sums).view(np.int64)[0])


def set_keys(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, node): node is the key of the set of shingles, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = shingle_sets(part.column(text_col), size)
                nodes = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
                sizes = pa.array(map(len, sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(id_col), sizes, nodes], [id_col, "n_shingles", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, node long")


def signatures(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, n, signature, bands) of the texts, each set once for a task's block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = {_node(s): s for s in shingle_sets(part.column(text_col), size) if len(s)}
                if not sets:
                    continue
                found = minima(list(sets.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sets, pa.int64()),
                        pa.array(map(len, sets.values()), pa.int64()),
                        pa.array([x.tobytes() for x in found], pa.binary()),
                        _longs(list(band_keys(found).view(U64))),
                    ],
                    ["node", "n", "signature", "bands"],
                )

    return docs.select(text_col).mapInArrow(run, "node long, n long, signature binary, bands array<long>")


def sets_of(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, shingles) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = {_node(s): s for s in shingle_sets(part.column(text_col), size) if len(s)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets, pa.int64()), _longs(list(sets.values()))], ["node", "shingles"]
                )

    return docs.select(text_col).mapInArrow(run, "node long, shingles array<long>")


def _agreeing(pairs: DataFrame, signed: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree in at least that share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_signatures(batch.column(c).to_pylist()) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    a = signed.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    b = signed.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    sized = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _signatures(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint32).reshape(-1, BANDS * ROWS)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    n = (F.size("sa") + F.size("sb")).cast("long")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", n.alias("n"), common.alias("c"))
    return both.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def _chunked(rows: DataFrame, key: str, weight: Column, limit: int, columns: list[str], name: str) -> DataFrame:
    """Rows of each key in lists of about `limit` of summed weight: (key, <name>_chunk, <name>)."""
    total = rows.groupBy(key).agg(F.sum(weight).alias("total"))
    number = F.pmod(F.xxhash64("node", F.lit(77)), F.ceil(F.col("total") / limit)).alias(f"{name}_chunk")
    dealt = rows.join(total, key).select(key, number, *columns).repartition(key, f"{name}_chunk")
    return dealt.groupBy(key, f"{name}_chunk").agg(F.collect_list(F.struct(*columns)).alias(name))


def _links_into(attached: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A link from each attached node into the component it is attached to, if there is any.

    `attached` has (target, node), `members` (target, node). Both sides come in
    chunks of full sets; a task compares two chunks and gives back at most one
    link for each attached node, since more say nothing new about components.
    """
    sized = sets.withColumn("weight", F.size("shingles").cast("long"))
    sides = [
        _chunked(rows.join(sized, "node"), "target", F.col("weight"), CHUNK_KEYS, ["node", "shingles"], name)
        for rows, name in ((attached, "l"), (members.join(attached.select("target").distinct(), "target", "left_semi"), "r"))
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("l"), batch.column("r")):
                right = right.values
                sizes = np.diff(right.field("shingles").offsets.to_numpy(zero_copy_only=False))
                keys = right.field("shingles").flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                nodes = right.field("node").to_numpy(zero_copy_only=False)
                a, b = [], []
                for node, own in zip(left.values.field("node").to_pylist(), left.values.field("shingles")):
                    own = own.values.to_numpy(zero_copy_only=False)
                    low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                    common = np.bincount(owner[ragged(low, high - low)], minlength=len(sizes))
                    alike = np.flatnonzero(100 * common >= percent * (sizes + len(own) - common))
                    if len(alike):
                        a.append(node)
                        b.append(int(nodes[alike[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sides[0].join(sides[1], "target").select("l", "r").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's members that are in different components and whose signatures agree.

    `members` has (bucket, node, component). Chunks of members are compared in a
    task each; a pair is given out in the first bucket that it shares only.
    """
    rows = members.join(signed.select("node", "signature"), "node")
    columns = ["node", "component", "signature"]
    left, right = (_chunked(rows, "bucket", F.lit(1), CHUNK, columns, name) for name in ("l", "r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, same, left, right in zip(*(batch.column(c) for c in ("bucket", "same", "l", "r"))):
                sides = []
                for side in (left.values, right.values):
                    own = _signatures(side.field("signature").to_pylist())
                    sides.append((*(side.field(c).to_numpy(zero_copy_only=False) for c in columns[:2]), own, band_keys(own)))
                (a, ca, sa, ba), (b, cb, sb, bb) = sides
                for i in range(len(a)):
                    some = ((sb == sa[i]).mean(axis=1) >= least) & (cb != ca[i])
                    if same.as_py():
                        some &= a[i] < b
                    first = np.argmax(bb[some] == ba[i], axis=1) if some.any() else []
                    found = b[some][ba[i][first] == bucket.as_py()] if len(first) else b[:0]
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(found, a[i])), pa.array(np.maximum(found, a[i]))], ["a", "b"]
                        )

    both = left.join(right, "bucket").where("l_chunk <= r_chunk")
    return both.select("bucket", (F.col("l_chunk") == F.col("r_chunk")).alias("same"), "l", "r").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, size: int = 5, percent: int = 80, slack: float = 0.18
) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked over Jaccard similarity of word shingles.

    Texts are lower-cased in ASCII and split at ASCII white space. Documents with
    equal sets of shingles are one node from the start, however many they are.

    1. Each node gets `BANDS * ROWS` minima of universal hashes; the bands of
       `ROWS` minima are its buckets. A pair with similarity 0.8 shares no bucket
       with a chance of 3e-6.
    2. All members of a bucket are compared with its most popular member (the
       one whose buckets are fullest, so near the middle of its group) and with
       one drawn by hash. A pair goes on if its signatures agree nearly as often
       as the similarity asks (`slack` below it, over five standard errors), and
       is a link if the full sets confirm it. Components of these links come
       from alternating large-star and small-star.
    3. A bucket may still hold several components. Its members outside its
       largest one are compared with all of that one, on full sets, and with each
       other, by signature and then on full sets. Tasks compare chunks of
       members; what they give out is links and the few pairs whose signatures
       agree, never all pairs. So no link between components that share a
       bucket is lost. Components are then taken again.

    A text of fewer words than `size` is one shingle of all its words. Null and
    empty texts have no shingle and are alone. Equal ids with different texts are
    judged by text; the least id of a component is its id, and every row of a
    document with that id is kept. Null ids are never a component's least id.
    """
    docs = docs.select(id_col, text_col)
    least = percent / 100 - slack
    rows = written(set_keys(docs, id_col, text_col, size), "nodes")
    signed = written(signatures(docs, text_col, size).dropDuplicates(["node"]), "signatures")
    buckets = signed.select("node", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(buckets.join(full, "bucket"), "buckets")
    popular = shared.join(shared.groupBy("node").agg(F.sum("size").alias("popular")), "node")
    centres = popular.groupBy("bucket").agg(
        F.max(F.struct("popular", "node"))["node"].alias("c1"),
        F.min(F.struct(F.xxhash64("node").alias("o"), "node"))["node"].alias("c2"),
    )
    starred = shared.join(centres, "bucket").select("node", F.explode(F.array("c1", "c2")).alias("c")).where("node <> c")
    pairs = starred.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    pairs = written(_agreeing(pairs, signed, least, percent), "pairs")

    # one text of each node that shares a bucket is enough: the least id's, from which its set is made again
    owners = rows.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(id_col).alias(id_col))
    owners = owners.select(F.col(id_col).alias("owner")).distinct()
    texts = docs.join(owners, docs[id_col].eqNullSafe(owners["owner"]), "left_semi")
    sets = written(sets_of(texts, text_col, size).dropDuplicates(["node"]), "sets")
    links = written(_linked(pairs, sets, percent), "links")
    found = components(links, "a", "b")
    found = written(found.join(found.groupBy("component").agg(F.count("*").alias("members")), "component"), "components")

    own = F.coalesce("component", "node").alias("component")
    placed = written(shared.join(found, "node", "left").select("bucket", "node", own, F.coalesce("members", F.lit(1)).alias("members")), "placed")
    mixed = placed.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("members", "component")).alias("main")
    ).where("lo <> hi")
    outside = placed.join(mixed.select("bucket", "main"), "bucket").where("component <> main.component or main.members = 1")
    outside = written(outside.select("bucket", "node", "component", "main"), "outside")
    attached = outside.where("main.members > 1").select(F.col("main.component").alias("target"), "node").distinct()
    into = _links_into(attached, found.select(F.col("component").alias("target"), "node"), sets, percent)
    beside = written(_across(outside, signed, least), "pairs").join(pairs, ["a", "b"], "left_anti")
    more = into.union(_linked(beside, sets, percent))
    found = written(components(links.union(more), "a", "b"), "components")

    named = rows.where("node is not null").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min(id_col).alias("component_id"))
    in_one = named.join(least_id, "component").select(id_col, "n_shingles", "component_id")
    alone = rows.where("node is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    return in_one.union(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
