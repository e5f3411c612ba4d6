"""Stop words and lemmas as table lookups."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from forumlens.functions.text import split_words

WHITE_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"  # as `split_words` splits


def _exploded(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    return df.select(*ids, F.posexplode(split_words(F.col(text))).alias("pos", "word"))


def _rejoined(words: DataFrame, df: DataFrame, ids: Sequence[str], target: str) -> DataFrame:
    """Words back into one text per row; a row's words are as many as it held before."""
    text = words.groupBy(*ids).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " "
        ).alias(target)
    )
    return df.join(text, list(ids), "left").withColumn(target, F.coalesce(target, F.lit("")))


def stop_and_lemmatise(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    stop_words: Sequence[str],
    lemmas: DataFrame,
    target: str = "lemmatized_text",
    tags: DataFrame | None = None,
) -> DataFrame:
    """Drop stop words, replace words by their lemma, drop lemmas that are stop words.

    `lemmas(token, pos, lemma)` is supplied by the user. `tags(*ids, pos_in_text,
    tag)` optionally gives part-of-speech tags; without it the table's `pos` is
    ignored and each token must occur once. The first stop-word pass ignores
    case, the second does not. `stop_words` is a fixed list of a language.
    """
    stops = F.array(*[F.lit(w) for w in stop_words])
    kept = _exploded(df, ids, text).where(~F.array_contains(stops, F.lower("word")))
    if tags is None:
        table = lemmas.select(F.col("token").alias("word"), "lemma")
        looked_up = kept.join(table, "word", "left")
    else:
        # First letter of a tag -> part of speech.
        word_class = F.create_map(*[F.lit(x) for x in ("J", "adj", "V", "verb", "N", "noun", "R", "adv")])
        tagged = tags.select(
            *ids,
            F.col("pos_in_text").alias("pos"),
            F.try_element_at(word_class, F.substring("tag", 1, 1)).alias("word_class"),
        )
        table = lemmas.select(F.col("token").alias("word"), F.col("pos").alias("word_class"), "lemma")
        looked_up = kept.join(tagged, [*ids, "pos"], "left").join(table, ["word", "word_class"], "left")
    lemma = F.coalesce("lemma", "word")
    final = looked_up.select(*ids, "pos", lemma.alias("word")).where(~F.array_contains(stops, F.col("word")))
    return _rejoined(final, df, ids, target)


def remove_words(
    df: DataFrame, ids: Sequence[str], text: str, words: DataFrame, target: str, staying: DataFrame | None = None
) -> DataFrame:
    """Remove every word listed in `words(term)`, e.g. the terms outside a vocabulary.

    Only the different words of a row are looked up, and what comes back to a
    text is the set of its listed words. `staying(term)` names some frequent
    words that are not listed, a bounded number: they are left out where they
    are read. Rows of the same ids are one text, their words in order of place.
    """
    known = reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in ids])
    rows = df.where(known).select(*ids, F.col(text).alias("text"))
    met = rows.select(*ids, F.explode(F.array_distinct(split_words(F.col("text")))).alias("word"))
    if staying is not None:
        met = met.join(F.broadcast(staying.select(F.col("term").alias("word"))), "word", "left_anti")
    listed = met.join(words.select(F.col("term").alias("word")), "word", "left_semi")
    gone = listed.groupBy(*ids).agg(F.collect_set("word").alias("gone"))
    texts = rows.groupBy(*ids).agg(F.collect_list("text").alias("texts")).join(gone, list(ids), "left")

    n, split = len(ids), re.compile(WHITE_SPACE).split
    schema = StructType([*(df.schema[i] for i in ids), StructField(target, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, listed in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                out_words = {"", *(listed or ())}
                if len(own) == 1:
                    out.append(" ".join([w for w in split(own[0]) if w not in out_words]))
                else:
                    placed = sorted(p for t in own for p in enumerate(w for w in split(t) if w))
                    out.append(" ".join([w for _, w in placed if w not in out_words]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], schema.names)

    text_of = texts.select(*ids, "texts", "gone").mapInArrow(run, schema)
    return df.join(text_of, list(ids), "left").withColumn(target, F.coalesce(target, F.lit("")))
