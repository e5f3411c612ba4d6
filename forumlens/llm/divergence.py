"""How far each source's word use is from its language and from other sources: an audit of groups.

Terms are runs of letters (A-Z lower-cased, and all characters outside ASCII).
A group's share of a term is 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares
p and q differ by floor((p - q)^2 / (p + q)). All arithmetic is exact.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.batches import FOLD, U64, flat, give_back, mix, ragged, slices, split_words
from forumlens.session import written

UNIT = 1_000_000_000
HELD_TERMS = 400_000  # counted terms that a task holds before it passes them on
KEYED_BYTES = 64  # of a term: polynomial keys of long regular ones can meet
TILE_SOURCES = 32  # about as many sources to a tile of the pair sums
BLOCK_TERMS = 512  # about as many terms to a block of them
LETTERS = np.ones(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
COUNTED = "lang string, source string, term string, n long, docs long"


class _Counts:
    """Occurrences and documents of (group, term) pairs, added up over blocks of text."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.terms: list[pa.Array] = []
        self.size = 0

    def add(self, part: pa.RecordBatch, text_col: str, lang_col: str, source_col: str) -> None:
        words = split_words(part.column(text_col), LETTERS, FOLD)
        n = words.counts()
        if not len(words.keys):
            return
        for i in np.flatnonzero(words.ends - words.starts > KEYED_BYTES):
            words.keys[i] = int.from_bytes(blake2b(words.word(i), digest_size=8).digest(), "little")
        names = zip(part.column(lang_col).to_pylist(), part.column(source_col).to_pylist())
        group = np.array([self.groups.setdefault((a or "", b or ""), len(self.groups)) for a, b in names], np.int64)
        keys, at, word = np.unique(words.keys, return_index=True, return_inverse=True)
        # distinct words of documents, then of groups
        doc = np.repeat(np.arange(len(n)), n)
        pair, count = np.unique(doc * len(keys) + word, return_counts=True)
        both, back = np.unique(group[pair // len(keys)] * len(keys) + pair % len(keys), return_inverse=True)
        occurs = np.bincount(back, count, len(both)).astype(np.int64)
        docs = np.bincount(back, minlength=len(both))
        starts, lengths = words.starts[at], words.ends[at] - words.starts[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        data = words.data[ragged(starts, lengths)]
        texts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
        place = both % len(keys)
        self.parts.append((both // len(keys), keys[place], occurs, docs, self.size + np.arange(len(both))))
        self.terms.append(texts.take(pa.array(place)))
        self.size += len(both)

    def merged(self, names: list[str]) -> pa.RecordBatch:
        """One row for each group and term met so far."""
        group, key, occurs, docs, at = (np.concatenate(x) for x in zip(*self.parts))
        _, first, back = np.unique(mix(key + mix(group.astype(U64) + U64(1))), return_index=True, return_inverse=True)
        sums = [np.zeros(len(first), np.int64) for _ in range(2)]
        np.add.at(sums[0], back, occurs)
        np.add.at(sums[1], back, docs)
        groups = list(self.groups)
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group[first])) for i in (0, 1))
        term = pa.chunked_array(self.terms).combine_chunks().take(pa.array(at[first])).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, source, term, *map(pa.array, sums)], names)


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and the documents that hold it.

    Tasks add up what they read, so what is shuffled are a task's distinct
    terms, not words; a group with a third of all documents is spread by term.
    """
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for batch in batches:
            for part in slices(batch, text_col):
                held.add(part, text_col, lang_col, source_col)
                if held.size > HELD_TERMS:
                    yield held.merged(names)
                    held.clear()
        if held.parts:
            yield held.merged(names)
        give_back()

    texts = docs.where(F.col(text_col).isNotNull()).select(text_col, lang_col, source_col)
    found = texts.mapInArrow(run, COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals so that no product overflows."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


class Skyband:
    """Rows of one group that fewer than `k` others dominate, met in order of (falling n, lang_n, term).

    A row dominates another if it has the same or a higher count in the group,
    the same or a lower count in the language, and an earlier term. In the
    order met, all that dominate a row come before it; and if k rows dominate
    it, k rows of the skyband do. So a row is kept if fewer than k kept terms
    are smaller among those of the same or a lower `lang_n`. These are found in
    a tree of prefixes over `lang_n`, of which each node needs its k smallest
    terms only.
    """

    def __init__(self, k: int):
        self.k = k
        self.nodes: dict[int, list[bytes]] = {}
        self.top = 0  # the largest lang_n that nodes reach: a power of two

    def _enter(self, at: int, term: bytes) -> None:
        while at <= self.top:
            held = self.nodes.setdefault(at, [])
            if len(held) < self.k:
                insort(held, term)
            elif term < held[-1]:
                held.pop()
                insort(held, term)
            at += at & -at

    def _reach(self, lang_n: int) -> None:
        """Double the tree until it holds `lang_n`; its top node covers all terms met so far."""
        while self.top < lang_n:
            old, self.top = self.top, max(1, 2 * self.top)
            if old in self.nodes:
                self.nodes[self.top] = list(self.nodes[old])

    def meet(self, lang_n: int, term: bytes) -> bool:
        """Whether the row is of the skyband; rows have to come in order."""
        self._reach(lang_n)
        found, at = 0, lang_n
        while at and found < self.k:
            found += bisect_left(self.nodes.get(at, ()), term)
            at -= at & -at
        if found >= self.k:
            return False
        self._enter(lang_n, term)
        return True


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's rows (lang, source, term, n, lang_n) those that fewer than `k` of their group dominate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, Skyband(k)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            lang, source, terms, _, lang_n = (batch.column(i) for i in range(5))
            columns = (lang.to_pylist(), source.to_pylist(), terms.cast(pa.binary()).to_pylist(), lang_n.to_pylist())
            for i, (a, b, term, count) in enumerate(zip(*columns)):
                if (a, b) != group:
                    group, band = (a, b), Skyband(k)
                keep[i] = band.meet(count, term)
            yield batch.filter(pa.array(keep))

    ordered = rows.select("lang", "source", "term", "n", "lang_n").sortWithinPartitions(
        "lang", "source", F.desc("n"), "lang_n", "term"
    )
    return ordered.mapInArrow(run, "lang string, source string, term string, n long, lang_n long")


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tile(rows: pa.Table) -> pa.Table:
    """Sums of differences of all pairs of sources of two tiles over one block of terms.

    A row has a source, its tile, its share `zero` of a term that it lacks, and
    a term with its share `p`; a row without a term stands for the source
    itself. Terms that no source of either tile has are not there: they are
    counted as missing and added later.
    """
    lang, first, second = (rows.column(c)[0].as_py() for c in ("lang", "first", "second"))
    sources = rows.column("source").combine_chunks().dictionary_encode()
    # in order of names: rows meet in any order, and every block has to name a pair the same way round
    order = np.asarray(pc.sort_indices(sources.dictionary))
    names, own = sources.dictionary.take(pa.array(order)), np.argsort(order)[np.asarray(sources.indices)]
    tile, zero = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    tile[own] = np.asarray(rows.column("tile"), np.int64)
    zero[own] = np.asarray(rows.column("zero"), np.int64)
    some = pc.is_valid(rows.column("term"))
    terms = rows.column("term").filter(some).combine_chunks().dictionary_encode()
    there = np.asarray(some)
    shares = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
    shares[own[there], np.asarray(terms.indices)] = np.asarray(rows.column("p").filter(some), np.int64)
    out_a, out_b, sums = [], [], []
    for a in np.flatnonzero(tile == first):
        others = np.flatnonzero(tile == second)
        if first == second:
            others = others[others > a]
        out_a.append(np.full(len(others), a))
        out_b.append(others)
        sums.append(_difference(shares[a][None, :], shares[others]).sum(axis=1))
    a, b = flat(out_a, np.int64), flat(out_b, np.int64)
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "a": names.take(pa.array(a)).cast(pa.string()),
            "b": names.take(pa.array(b)).cast(pa.string()),
            "zero_a": pa.array(zero[a]),
            "zero_b": pa.array(zero[b]),
            "value": pa.array(flat(sums, np.int64)),
            "terms": pa.array(np.full(len(a), len(terms.dictionary)), pa.int64()),
        }
    )


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group and each other source of its language.

    Sources are dealt over tiles and terms over blocks; a task has two tiles
    and a block, whatever the sizes of groups, languages or vocabularies. A
    source is sent once for each tile of its language and block of terms; that
    is the result's own size, one row for each pair, times the blocks.
    """
    tiles = (F.col("sources") / TILE_SOURCES).cast("bigint") + 1
    blocks = (F.col("kept") / BLOCK_TERMS).cast("bigint") + 1
    sized = groups.withColumn("tiles", tiles).withColumn("blocks", blocks)
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    marks = sized.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    marks = marks.select("lang", "source", "tiles", "tile", "block", "zero", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("p"))
    place = sized.select("lang", "source", "tiles", "tile", "blocks", "zero")
    terms = shares.join(place, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    rows = marks.unionByName(terms.select(*marks.columns))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other"))
    schema = "lang string, a string, b string, zero_a long, zero_b long, value long, terms long"
    sums = rows.groupBy("lang", "block", "first", "second").applyInArrow(_tile, schema)
    added = sums.groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("zero_a").alias("p"), F.max("zero_b").alias("q")
    )
    kept = groups.select("lang", "kept").distinct()
    whole = added.join(kept, "lang").withColumn("value", F.col("value") + (F.col("kept") - F.col("terms")) * difference("p", "q"))
    ways = (("a", "b"), ("b", "a"))
    both = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ways]))
    found = whole.select("lang", "value", both.alias("pair")).select("lang", "pair.source", "pair.item", "value")
    # languages without a kept term: all values are 0
    bare = groups.where("kept = 0").select("lang", "source")
    others = bare.select("lang", F.col("source").alias("item"))
    none = bare.join(others, "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    return found.unionByName(none.select(*found.columns))


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(
    docs: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int = 10, top: int = 10
) -> DataFrame:
    """Differences of every (lang, source) group from other sources and from its language.

    A language keeps the terms of at least `least_docs` of its documents. Part
    `pair` has, for each other source of the language, the sum of differences
    over all kept terms; part `term` the `top` terms that a group uses more
    than its language does. Both are ranked, ties by item in UTF-8 order. The
    result is (lang, source, part, item, value, rank).

    The difference of a term rises with its count in the group and falls with
    its count in the language, so a term that `top` others of the group
    dominate in both, with an earlier name, has no place in the list. Each
    partition of the counted terms keeps its skyband (`Skyband`), the bands of
    a group are merged to its own, and only these terms are given shares and
    ranked exactly. Groups are streamed in order; a task holds a tree of short lists.
    Pair sums run over tiles of sources and blocks of terms.

    A null text, lang or source is read as empty; a group occurs even if none
    of its documents has a term. Texts have any length; repeated rows are
    documents each. An empty table gives no row. Other columns are ignored, so
    their names cannot clash.
    """
    docs = docs.select(
        F.col(text_col).alias("text"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
    )
    counts = written(count_terms(docs, "text", "lang", "source"), "counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = of_lang.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n")
    kept = written(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    # group sizes: one row for each (lang, source)
    langs = of_lang.where(F.col("docs") >= least_docs).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    occurring = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"])
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    own_zero = F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).otherwise(zero)
    groups = written(groups.join(sources, "lang").withColumn("zero", own_zero), "groups")
    sizes = groups.select("lang", "source", "total", "kept", "lang_total")

    shares = kept.join(sizes, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    )
    pairs = pair_values(groups, shares).withColumn("part", F.lit("pair"))

    local = skyband(kept, top)
    merged = skyband(local.repartition("lang", "source"), top)
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    ranked = merged.join(sizes, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    ranked = ranked.select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = ranked.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(best.where(F.col("rank") <= top).select(*columns))


def check_sql() -> str:
    """DuckDB SQL of the registered query on `documents`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), numbered AS (SELECT row_number() OVER () AS doc, * FROM docs),
words AS (SELECT doc, lang, source, unnest(words) AS term FROM numbered),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
terms AS (
    SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
    SELECT l.lang, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0)::HUGEINT AS lang_total
    FROM (SELECT DISTINCT lang FROM docs) l
    LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM terms GROUP BY lang) t ON l.lang = t.lang
), kept AS (SELECT c.lang, c.source, c.term, c.n, t.lang_n FROM counts c JOIN terms t USING (lang, term)),
groups AS (
    SELECT g.lang, g.source, l.v, l.lang_total, coalesce(t.total, 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs l ON g.lang = l.lang
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM kept GROUP BY ALL) t ON g.lang = t.lang AND g.source = t.source
), shares AS (
    SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n,
           1 + (1000000000 * (coalesce(k.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
           1 + (1000000000 * (t.lang_n + 2)) // (g.lang_total + 2 * g.v) AS q
    FROM groups g JOIN terms t ON g.lang = t.lang
    LEFT JOIN kept k ON g.lang = k.lang AND g.source = k.source AND t.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item
), used AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
    FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM used)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
