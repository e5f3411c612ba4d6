"""From raw documents to packed training sequences: five stages, each by one operator.

Each stage takes (spark, docs, sf_dir) and gives back a DataFrame; `run` writes
it as Parquet and reads it again for the next stage. All stages but the last
return the columns of their input. Null and empty texts: the first stage
rejects them as texts of no language. Repeated rows (equal id and text) leave
the second stage once. Further columns of `documents` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm import decontamination, language, near_duplicates, packing, repeats
from forumlens.llm.batches import id_hash, table
from forumlens.llm.queries import tokenizer_path
from forumlens.session import written

# Below this probability of the best language a text counts as being in none.
LEAST_SCORE = 0.4


def _back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no recognisable language; a null `lang` gets the predicted one."""
    net = language.train(docs.where(id_hash("doc_id") % 4 != 2), "doc_id", "text", "lang")
    found = language.identify(docs, "text", net, prefix="stage_lang_")
    kept = found.where((F.col("stage_lang_pred") != language.UNKNOWN) & (F.col("stage_lang_score") >= LEAST_SCORE))
    return _back(kept.withColumn("lang", F.coalesce("lang", "stage_lang_pred")), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group of near duplicates (five-word shingles, 0.8)."""
    judged = near_duplicates.near_duplicates(docs, "doc_id", "text", size=5)
    kept = judged.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return _back(left.dropDuplicates(["doc_id", "text"]), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of repeated 35-word windows; texts without any stay as they are, line breaks included."""
    cut = repeats.remove_repeats(docs, "text", prefix="stage_rep_")
    text = F.when(F.col("stage_rep_n_removed") > 0, F.col("stage_rep_kept")).otherwise(F.col("text"))
    return _back(cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more are words of benchmark passages."""
    items = table(spark, sf_dir, "benchmark")
    found = decontamination.find_passages(docs, "text", items, "item_id", "text", prefix="stage_bench_")
    return _back(found.where(~decontamination.contaminated("stage_bench_")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Trained networks, components of a graph and tokenizers are beyond SQL; tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
