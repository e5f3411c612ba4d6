"""Document classes from word evidence combined with the record of a document's site, by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import BYTE_KEYS, BYTE_POWERS, U64, Words, mix, slices, split_words
from forumlens.session import written

SAMPLE = 20_000  # labelled texts that the word weights are learned from, at most
HELD = 4  # one in so many labelled ids is kept from the word weights, for the curve from evidence to odds
BUCKETS = 1 << 20
SIGNIFICANT = 20.0  # log-likelihood ratio (G) of a bucket's two-by-two table
RULE = np.full(256, ord("a"), np.uint8)  # letters and bytes outside ASCII
RULE[: 0x80] = np.arange(0x80)
RULE[ord("a") : ord("z") + 1] = ord("a")
RULE[ord("A") : ord("Z") + 1] = ord("A")
RULE[ord("0") : ord("9") + 1] = ord("9")


def shapes(words: Words) -> np.ndarray:
    """Keys of the words' shapes: runs of small letters, capitals and digits count once, other characters too."""
    if not len(words.keys):
        return words.keys
    ruled = RULE[words.data]
    keep = np.ones(len(ruled), bool)
    keep[1:] = ruled[1:] != ruled[:-1]
    keep[words.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    starts, ends, ruled = at[words.starts], at[words.ends], ruled[keep]
    up, down = BYTE_POWERS.upto(len(ruled) + 1)
    sums = np.zeros(len(ruled) + 1, U64)
    np.cumsum(BYTE_KEYS[ruled] * up[: len(ruled)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ U64(0x51A9E))


def features(texts: pa.Array) -> list[np.ndarray]:
    """Buckets of each whole text's distinct words and word shapes, and of how often its words repeat."""
    words = split_words(texts)
    both = np.stack([words.keys, shapes(words)])
    buckets = (both % U64(BUCKETS)).astype(np.int64)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        own = np.unique(buckets[:, a:b])
        if b > a:
            fresh = int(8 * len(np.unique(words.keys[a:b])) / (b - a))
            own = np.append(own, mix(np.array([fresh * 64 + int(b - a).bit_length() + 1], U64)) % U64(BUCKETS)).astype(np.int64)
        out.append(own)
    return out


def held_out(id_col: str) -> Column:
    """Labelled ids that word weights never see, whatever the number of labels."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(HELD)) == 0


def sampled(labelled: DataFrame, id_col: str, most: int) -> DataFrame:
    return labelled.where(~held_out(id_col)).orderBy(F.xxhash64(F.col(id_col), F.lit(8)), id_col).limit(most)


def word_weights(docs: DataFrame, id_col: str, text_col: str, sample: DataFrame, classes: list[str]) -> dict[str, np.ndarray]:
    """Log odds ratios of buckets between the two values of each class; 0 where the sample does not settle its sign."""
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * len(classes), BUCKETS), np.int32)
        for batch in batches:
            for part in slices(batch, text_col):
                values = [part.column(c).to_pylist() for c in classes]
                for i, own in enumerate(features(part.column(text_col))):
                    for k, column in enumerate(values):
                        if column[i] is not None:
                            held[2 * k + int(column[i] > 0), own] += 1
        some = np.flatnonzero(held.any(axis=0))
        columns = [pa.array(some), *(pa.array(h[some].astype(np.int64)) for h in held)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *names])

    names = [f"n{k}" for k in range(2 * len(classes))]
    counts = rows.mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(
        *(F.sum(n).alias(n) for n in names)
    )
    totals = sample.agg(*(F.count(F.when((F.col(c) > 0) == bool(v), 1)).alias(f"{c}_{v}") for c in classes for v in (0, 1))).first()
    cells = {}
    for k, c in enumerate(classes):
        no, yes = (F.col(f"n{2 * k + v}").cast("double") for v in (0, 1))
        all_no, all_yes = (float(totals[f"{c}_{v}"]) for v in (0, 1))
        weight = F.log((yes + 0.5) / (all_yes + 1)) - F.log((no + 0.5) / (all_no + 1))
        share = (yes + no) / max(all_no + all_yes, 1.0)
        settled = F.lit(0.0)
        for n, total in ((no, all_no), (yes, all_yes)):
            for seen, expected in ((n, share * total), (total - n, (1 - share) * total)):
                settled += F.when((seen > 0) & (expected > 0), 2 * seen * F.log(seen / expected)).otherwise(0.0)
        cells[c] = F.when(settled >= SIGNIFICANT, weight)
    picked = counts.select("bucket", *(cell.alias(c) for c, cell in cells.items()))
    found = picked.where(F.coalesce(*classes).isNotNull()).collect()
    made = {c: np.zeros(BUCKETS) for c in classes}
    for row in found:
        for c in classes:
            made[c][row["bucket"]] = row[c] or 0.0
    return made


def evidence(docs: DataFrame, text_col: str, weights: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns `keep`, and for each class the sum of a whole text's weights, damped by their number."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"evidence_{c}" for c in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                own = features(part.column(text_col))
                sums = []
                for w in sent.value.values():
                    used = [w[x] for x in own]
                    sums.append(pa.array([float(u.sum() / np.sqrt(1 + np.count_nonzero(u))) for u in used], pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *sums], [*keep, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    return rows.mapInArrow(run, schema + "".join(f", {n} double" for n in names))


@dataclass
class Level:
    """Shares of positives of the groups at one level, and how many rows the level above is worth."""

    rates: DataFrame
    strength: float


def shrunk(rows: DataFrame, label: str, groups: list[str], above: Column, name: str) -> Level:
    """Posterior share of positives of each group: its own labelled rows, with the level above as prior.

    The prior's weight follows from how much the groups' shares differ beyond
    chance (moments of the beta-binomial distribution). `above` is the prior's
    mean, a column that is constant in a group.
    """
    group = rows.groupBy(*groups).agg(
        F.count(label).alias("n"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("k"), F.first(above).alias("prior")
    )
    group = written(group, "groups")
    p = F.col("k") / F.col("n")
    moments = group.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("nn"),
        F.sum(F.col("n") * (p - F.col("prior")) ** 2).alias("s"), (F.sum("k") / F.sum("n")).alias("mean"),
    ).first()
    strength = 10.0
    if moments["g"] and 0 < moments["mean"] < 1:
        g, n = moments["g"], moments["n"]
        room = n - moments["nn"] / n - (g - 1)
        if room > 0:
            alike = (moments["s"] / (moments["mean"] * (1 - moments["mean"])) - (g - 1)) / room
            strength = 1 / min(max(alike, 1e-4), 0.99) - 1
    rate = (F.col("k") + strength * F.col("prior")) / (F.col("n") + strength)
    return Level(group.select(*groups, rate.alias(name)), strength)


def _joined(rows: DataFrame, level: Level, groups: list[str], name: str) -> DataFrame:
    other = level.rates.select(*(F.col(g).alias(f"__{g}") for g in groups), name)
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    on = same[0]
    for s in same[1:]:
        on &= s
    return rows.join(other, on, "left").drop(*(f"__{g}" for g in groups))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, id_col: str, text_col: str, site_col: str, path_col: str, labels: DataFrame, classes: list[str],
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, site, path, and for each class `<class>_evidence`, `_site`, `_path`, `_score`).

    A score is the posterior probability of a class (0 to 1), from three sources:
    word weights learned on at most `sample` labelled texts (the one bound; they
    are drawn by hash); a logistic curve from evidence to odds, fitted on the
    labelled rows that are held out from the draw, one in `HELD` ids at every
    size (without both values among them the evidence has no say); and the
    posterior of the document's path, which is shrunk to that of its site, and
    that to the share among all labelled rows. Shares count every labelled row;
    groups are aggregated before they are shuffled, so a site with a third of
    all documents is one row of each task.

    A null or empty text has no evidence. Null sites and paths are groups of
    their own. A label may be null; of repeated labels of an id the largest
    counts. Without labels of both values a class's scores are the plain share
    (0.5 if none). Repeated documents stay.
    """
    labels = labels.groupBy(id_col).agg(*(F.max(c).alias(c) for c in classes))
    drawn = written(sampled(labels, id_col, sample), "sample")
    weights = word_weights(docs, id_col, text_col, drawn, classes)
    keep = list(dict.fromkeys([id_col, site_col, path_col]))
    rows = evidence(docs, text_col, weights, keep)
    rows = written(rows.join(labels, id_col, "left"), "evidence")
    for c in classes:
        rows = rows.withColumn(c, (F.col(c) > 0).cast("double"))
        shares = rows.agg(F.avg(c).alias("all"), F.avg(F.when(held_out(id_col), F.col(c))).alias("held")).first()
        mean = 0.5 if shares["all"] is None else shares["all"]
        site = shrunk(rows, c, [site_col], F.lit(mean), f"{c}_site")
        rows = _joined(rows, site, [site_col], f"{c}_site")
        path = shrunk(rows, c, [site_col, path_col], F.col(f"{c}_site"), f"{c}_path")
        rows = _joined(rows, path, [site_col, path_col], f"{c}_path")
        ratio = F.lit(0.0)
        fitted_share = shares["held"]
        if fitted_share is not None and 0 < fitted_share < 1:
            fit_on = rows.where(F.col(c).isNotNull() & held_out(id_col))
            made = VectorAssembler(inputCols=[f"evidence_{c}"], outputCol="x").transform(fit_on.select(f"evidence_{c}", c))
            curve = LogisticRegression(featuresCol="x", labelCol=c, regParam=1e-4, maxIter=50).fit(made)
            ratio = curve.coefficients[0] * F.col(f"evidence_{c}") + curve.intercept - float(np.log(fitted_share / (1 - fitted_share)))
        least = F.least(F.greatest(F.col(f"{c}_path"), F.lit(1e-6)), F.lit(1 - 1e-6))
        rows = rows.withColumn(f"{c}_score", 1 / (1 + F.exp(-(logit(least) + ratio))))
    columns = [x for c in classes for x in (F.col(f"evidence_{c}").alias(f"{c}_evidence"), f"{c}_site", f"{c}_path", f"{c}_score")]
    return rows.select(*keep, *columns)
