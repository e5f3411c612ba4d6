"""Hard negatives of anchors by inner product, with length buckets and pruning by coordinates.

Rows are sorted by label and falling length and cut into buckets; a bucket also
holds its rows sorted by every coordinate. For an anchor q and a score t that a
row p must reach, lengths give |p| >= t / |q|; and if p has at most the length
l of the bucket's longest row, then with c = t / (|q| l) the unit vector of p
must have, in each coordinate f,

    q_f c - sqrt((1 - c^2)(1 - q_f^2)) <= p_f <= q_f c + sqrt((1 - c^2)(1 - q_f^2))

(q_f of the anchor's unit vector). The ranges of the anchor's largest (focus)
coordinates are looked up in the sorted lists; only rows in all of them are
verified, exactly, in whole numbers. The score to reach rises while better rows
are found. Scores are exact, so pruning never changes a result; ranges are
widened by a small margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.batches import flat, give_back
from forumlens.session import written

BUCKET_ROWS = 2048
BLOCK_BUCKETS = 16  # to a block at most, the unit of work that anchors are sent to
CHUNK_ANCHORS = 1024  # sent together
FOCUS = 4  # coordinates of an anchor that are looked up
PRUNED = 0.3  # a bucket whose rows are left by more than this share is verified whole
MARGIN = 1e-6
EXACT = 1 << 53  # below it sums of whole numbers are exact in 64-bit floats
LARGEST = (1 << 63) - 1
WIRE = "block long, kind int, part long, payload binary"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, x) of the rows that take part; x is floor(scale * component) of each component."""
    good = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    return kept.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint")).alias("x"),
    )


def packed(rows: pa.Table) -> bytes:
    """An Arrow payload, with vectors in the narrowest type of whole numbers that holds them."""
    vectors = rows.column("x").combine_chunks()
    least, most = pc.min_max(vectors.flatten()).as_py().values()
    if least is not None:
        kind = np.result_type(np.min_scalar_type(least), np.min_scalar_type(most))
        kind = pa.from_numpy_dtype(kind if kind.kind == "i" else np.promote_types(kind, np.int8))
        if pa.types.is_signed_integer(kind):
            rows = rows.set_column(rows.schema.get_field_index("x"), "x", vectors.cast(pa.list_(kind)))
    batch = rows.combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled with zeros."""
    rows = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(np.asarray(rows.offsets))
    values = np.asarray(rows.flatten(), np.int64)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Bucket:
    """Rows of similar length with their coordinates in order."""

    def __init__(self, rows: pa.Table):
        self.ids = np.asarray(rows.column("id"), np.int64)
        self.labels = np.asarray(rows.column("label"), np.int64)
        x = matrix(rows.column("x"))
        self.real, self.width = x.astype(np.float64), x.shape[1]
        self.lengths = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.largest = float(np.abs(self.real).max(initial=0.0))
        self.x = x if self.largest >= EXACT else None  # else the floats are exact
        unit = self.units(slice(None), slice(None))
        order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, order, axis=0)
        self.order = order.astype(np.int32)

    def units(self, rows, columns) -> np.ndarray:
        """Coordinates of rows scaled to length one; a row of zeros stays so."""
        lengths = self.lengths[rows]
        some = self.real[rows][:, columns] if isinstance(columns, slice) else self.real[rows, columns]
        lengths = np.where(lengths > 0, lengths, 1.0)
        return some / (lengths[:, None] if some.ndim > 1 else lengths)

    def scores(self, at, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows (a slice or positions) with anchors."""
        width = max(self.width, anchors.shape[1])
        if not self.width or not anchors.shape[1]:
            return np.zeros((len(self.ids[at]), len(anchors)), np.int64)
        bound = width * self.largest * float(np.abs(anchors.astype(np.float64)).max(initial=0))
        if bound < EXACT and self.width == anchors.shape[1]:
            return (self.real[at] @ anchors.T.astype(np.float64)).astype(np.int64)
        if bound >= LARGEST:
            raise OverflowError("inner products beyond 64 bits")
        own = self.real[at].astype(np.int64) if self.x is None else self.x[at]
        return fitted(own, width) @ fitted(anchors, width).T


class Anchors:
    """Anchors of a chunk with what they still need; `reach` is the least score that can matter."""

    def __init__(self, rows: pa.Table):
        self.keys = np.asarray(rows.column("anchor"), np.int64)
        self.ids = np.asarray(rows.column("id"), np.int64)
        self.labels = np.asarray(rows.column("label"), np.int64)
        self.x = matrix(rows.column("x"))
        real = self.x.astype(np.float64)
        self.lengths = np.sqrt((real**2).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.where(self.lengths[:, None] > 0, real / self.lengths[:, None], 0.0)
        n = min(FOCUS, self.x.shape[1])
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :n]
        self.reach = np.full(len(self.ids), -np.inf)


def candidates(bucket: Bucket, anchors: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
    """(anchors, rows to verify) such that every row reaching an anchor's score is among its rows."""
    longest = bucket.longest * anchors.lengths
    alive = (anchors.reach <= longest * (1 + MARGIN) + MARGIN) & (len(bucket.ids) > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.clip(np.where(longest > 0, anchors.reach / longest, -1.0), -1.0, 1.0)
    # a score to reach of zero or less bounds no row whose length is unknown
    prunable = alive & (c > 0) & (bucket.width == anchors.x.shape[1])
    whole = alive & ~prunable
    at = np.flatnonzero(prunable)
    if len(at):
        f = anchors.focus[at]
        q = np.take_along_axis(anchors.unit[at], f, axis=1)
        spread = np.sqrt(np.maximum(0.0, (1 - c[at] ** 2)[:, None] * (1 - q**2))) + MARGIN
        low, high = q * c[at][:, None] - spread, q * c[at][:, None] + spread
        # beyond these the bound of a row of smaller angle is wider: p_f may reach 1 if q_f >= c
        high = np.where(q >= c[at][:, None], np.inf, high)
        low = np.where(-q >= c[at][:, None], -np.inf, low)
        first, last = np.zeros(f.shape, np.int64), np.zeros(f.shape, np.int64)
        for d in np.unique(f):
            here = f == d
            first[here] = np.searchsorted(bucket.sorted[:, d], low[here], "left")
            last[here] = np.searchsorted(bucket.sorted[:, d], high[here], "right")
        count = np.maximum(last - first, 0)
        best = count.argmin(axis=1)
        for i, a in enumerate(at):
            b = best[i]
            if count[i, b] > PRUNED * len(bucket.ids):
                whole[a] = True
                continue
            rows = bucket.order[first[i, b] : last[i, b], f[i, b]]
            for j in range(f.shape[1]):
                if j != b and len(rows):
                    p = bucket.units(rows, f[i, j])
                    rows = rows[(p >= low[i, j]) & (p <= high[i, j])]
            if len(rows):
                yield np.array([a]), rows
    at = np.flatnonzero(whole)
    if len(at):
        yield at, slice(None)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best scores, ties by smaller id."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class Positives:
    """The n best rows of each anchor's label."""

    fields = [("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]

    def __init__(self, rows: pa.Table, n: int):
        self.anchors, self.n = Anchors(rows), n
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.anchors.ids]

    def meet(self, bucket: Bucket) -> None:
        own = self.anchors
        low, high = bucket.labels.min(initial=LARGEST), bucket.labels.max(initial=-LARGEST)
        away = (own.labels < low) | (own.labels > high)
        reach = own.reach.copy()
        own.reach[away] = np.inf
        for at, rows in candidates(bucket, own):
            scores, ids, labels = bucket.scores(rows, own.x[at]), bucket.ids[rows], bucket.labels[rows]
            for k, a in enumerate(at):
                fit = np.flatnonzero((labels == own.labels[a]) & (ids != own.ids[a]) & (scores[:, k] >= reach[a]))
                if len(fit):
                    s, i = self.found[a]
                    s, i = np.concatenate([s, scores[fit, k]]), np.concatenate([i, ids[fit]])
                    top = best(s, i, self.n)
                    self.found[a] = s[top], i[top]
                    if len(top) == self.n:
                        reach[a] = s[top].min()
        own.reach = reach

    def columns(self) -> list:
        n = [len(s) for s, _ in self.found]
        return [
            np.repeat(self.anchors.keys, n),
            flat([i for _, i in self.found], np.int64),
            flat([s for s, _ in self.found], np.int64),
        ]


class Negatives:
    """For each positive of an anchor the n best rows of other labels within its range of scores."""

    fields = [("anchor", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]

    def __init__(self, rows: pa.Table, n: int):
        self.anchors, self.n = Anchors(rows), n
        self.low = rows.column("low").to_pylist()  # one range for each positive
        self.high = rows.column("high").to_pylist()
        none = np.zeros(0, np.int64)
        self.found = [[(none, none) for _ in own] for own in self.low]
        for a in range(len(self.low)):
            self._set_reach(a)

    def _set_reach(self, a: int) -> None:
        """The least score that can still enter one of the anchor's lists."""
        needs = [
            max(low, int(s.min())) if len(s) == self.n else low
            for low, high, (s, _) in zip(self.low[a], self.high[a], self.found[a])
            if low <= high
        ]
        self.anchors.reach[a] = min(needs, default=np.inf)

    def meet(self, bucket: Bucket) -> None:
        own = self.anchors
        for at, rows in candidates(bucket, own):
            scores, ids, labels = bucket.scores(rows, own.x[at]), bucket.ids[rows], bucket.labels[rows]
            for k, a in enumerate(at):
                own_scores = scores[:, k]
                fit = np.flatnonzero((own_scores >= own.reach[a]) & (labels != own.labels[a]))
                if not len(fit):
                    continue
                s, i = own_scores[fit], ids[fit]
                for place, (low, high) in enumerate(zip(self.low[a], self.high[a])):
                    inside = np.flatnonzero((s >= low) & (s <= high))
                    if len(inside):
                        old_s, old_i = self.found[a][place]
                        all_s, all_i = np.concatenate([old_s, s[inside]]), np.concatenate([old_i, i[inside]])
                        top = best(all_s, all_i, self.n)
                        self.found[a][place] = all_s[top], all_i[top]
                self._set_reach(a)

    def columns(self) -> list:
        rows = [
            (key, place, s, i)
            for key, own in zip(self.anchors.keys.tolist(), self.found)
            for place, (s, i) in enumerate(own)
        ]
        n = [len(s) for _, _, s, _ in rows]
        return [
            np.repeat(np.array([r[0] for r in rows], np.int64), n),
            np.repeat(np.array([r[1] for r in rows], np.int64), n),
            flat([r[3] for r in rows], np.int64),
            flat([r[2] for r in rows], np.int64),
        ]


def to_buckets(rows: DataFrame) -> DataFrame:
    """Write the rows as buckets: block, part, the labels within, and the rows as an Arrow payload.

    Rows are dealt over blocks by ranges of (label, length, id), so blocks have
    about the same number of rows however many share a label or a length. With
    few rows there are as many blocks as the session has shuffle partitions.
    """
    n = rows.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(n // (BUCKET_ROWS * BLOCK_BUCKETS) + 1, min(n // BUCKET_ROWS + 1, spread))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    keyed = rows.withColumn("square", square)
    order = [F.col("label"), F.col("square").desc(), F.col("id")]
    dealt = keyed.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id().cast("bigint"))
    dealt = dealt.sortWithinPartitions("block", *order).select("block", "id", "label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, part = None, None, 0

        def bucket(rows: pa.Table):
            labels = rows.column("label").unique()
            values = [[block], [part], [labels.to_pylist()], [packed(rows.drop_columns("block"))]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(values, kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["block", "part", "labels", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0)[0].as_py()  # a task holds one block
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= BUCKET_ROWS:
                yield bucket(held.slice(0, BUCKET_ROWS).combine_chunks())
                held, part = held.slice(BUCKET_ROWS), part + 1
        if held is not None and held.num_rows:
            yield bucket(held.combine_chunks())

    return written(dealt.mapInArrow(run, "block long, part long, labels array<long>, payload binary"), "buckets")


def to_chunks(anchors: DataFrame) -> DataFrame:
    """Anchors in sorted chunks: `chunk`, the labels within, and the anchors as an Arrow payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def chunk():
            rows = pa.Table.from_batches(held).combine_chunks()
            labels = rows.column("label").unique().to_pylist()
            first = rows.column("anchor")[0].as_py()  # numbers of anchors are unique, so this names the chunk
            return pa.RecordBatch.from_arrays(
                [pa.array([first], pa.int64()), pa.array([labels], pa.list_(pa.int64())), pa.array([packed(rows)], pa.binary())],
                ["chunk", "labels", "payload"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ANCHORS):
                part = batch.slice(at, CHUNK_ANCHORS)
                if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK_ANCHORS:
                    yield chunk()
                    held.clear()
                held.append(part)
        if held:
            yield chunk()

    return anchors.mapInArrow(run, "chunk long, labels array<long>, payload binary")


def search(buckets: DataFrame, count: int, sent: DataFrame, seeker: type, n: int) -> DataFrame:
    """Let every chunk of anchors in `sent` (block, chunk, payload) meet the buckets of its block, one of `count`.

    The buckets of a block are held by one task, longest rows first, and the
    chunks stream past them, so neither side's size matters. Chunks come with
    nothing found; what a block finds for them is a row for each hit.
    """
    rows = buckets.select("block", F.lit(0).alias("kind"), "part", "payload").unionByName(
        sent.select("block", F.lit(1).alias("kind"), F.col("chunk").alias("part"), "payload")
    )
    dealt = rows.repartitionById(count, F.col("block").cast("int")).sortWithinPartitions("block", "kind", "part")
    schema = pa.schema(seeker.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for at, kind, _, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != block:
                    block, held = at, []
                if kind == 0:
                    held.append(Bucket(opened(payload)))
                    held.sort(key=lambda b: -b.longest)
                    continue
                chunk = seeker(opened(payload), n)
                for bucket in held:
                    chunk.meet(bucket)
                columns = [pa.array(c, pa.int64()) for c in chunk.columns()]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return dealt.mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def top(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best rows by (score, id) of each key with their `rank`; tasks keep n of a key before they meet."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    label_col: str,
    is_anchor,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """Hard negatives of the anchors: rows of other labels that score nearly as high as a positive.

    Components become floor(scale * x) and scores are exact inner products.
    An anchor's positives are its `positives` best other rows of the same
    label; for each, its `negatives` best rows of other labels with a score of
    `low` to `high` hundredths of the positive's are returned as (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score). Ties go to
    the smaller id. `is_anchor` is a condition on `id` and `label`.

    Anchors meet the blocks that hold their label for positives, then all
    blocks for negatives, in chunks of `CHUNK_ANCHORS`; the rows themselves
    are moved once to blocks of bounded size and once to each search. No task
    holds more than a block, whatever share of the rows has one label.

    Rows with a null id, label, vector or component, or with a component that
    is not finite, take no part. Rows with the anchor's id are not "other"
    rows; repeated rows are candidates each, and anchors each, so they repeat
    results. A shorter vector counts as filled up with zeros. Scores beyond 64
    bits raise an error. An empty table gives no row. Other columns are
    ignored, so their names cannot clash.
    """
    rows = whole_vectors(df, id_col, vector_col, label_col, scale)
    return mine_whole(rows, is_anchor, positives, negatives, low, high)


def floored(hundredths: str) -> str:
    """SQL of a whole number s times some hundredths, rounded down, in decimals that do not overflow."""
    product = f"({hundredths} * cast(s as decimal(20, 0)))"
    return f"(({product} - pmod({product}, 100)) div 100)"


def mine_whole(rows: DataFrame, is_anchor, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """`mine` on (id, label, x) rows of whole numbers."""
    buckets = to_buckets(rows)
    count = buckets.agg(F.max("block")).first()[0]
    count = 1 if count is None else count + 1
    numbered = rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id())
    anchors = written(numbered.select("anchor", "id", "label", "x"), "anchors")
    # positives: chunks go to the blocks that hold one of their labels
    chunks = written(to_chunks(anchors.repartitionByRange("label", "anchor").sortWithinPartitions("label", "anchor")), "chunks")
    blocks = buckets.select("block", F.explode("labels").alias("label")).distinct()
    wanted = chunks.select("chunk", F.explode("labels").alias("label")).join(blocks, "label").select("chunk", "block").distinct()
    sent = chunks.select("chunk", "payload").join(wanted, "chunk")
    near = top(search(buckets, count, sent, Positives, positives), ["anchor"], positives)
    listed = near.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("near")
    )
    # negatives: every block, with the range of scores of each positive
    held = written(
        anchors.join(listed, "anchor").select(
            "anchor",
            "id",
            "label",
            "x",
            "near",
            F.expr(f"transform(near.positive_score, s -> -{floored(f'-{low}')})").alias("low"),
            F.expr(f"transform(near.positive_score, s -> {floored(str(high))})").alias("high"),
        ),
        "held",
    )
    everywhere = to_chunks(held.select("anchor", "id", "label", "x", "low", "high"))
    sent = everywhere.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    hard = top(search(buckets, count, sent, Negatives, negatives), ["anchor", "place"], negatives)
    positive = held.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("near").alias("place", "near"))
    joined = hard.join(positive.withColumn("place", F.col("place").cast("bigint")), ["anchor", "place"])
    return joined.select(
        "anchor_id",
        "near.positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "near.positive_score",
        F.col("score").alias("negative_score"),
    )


def check_sql() -> str:
    """DuckDB SQL of the registered query on `embeddings`."""
    return """
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""
