"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm import decontamination, divergence, extraction, fingerprints, hard_negatives, language, language_model, licenses, near_duplicates, packing, quality, repeats, swap_packing
from forumlens.llm.batches import id_hash, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return register(fn) if fn else register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that are left after cutting repeated windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.remove_repeats(docs, "text")
    return cut.select(
        "doc_id",
        F.col("rep_n_words").alias("n_words"),
        F.col("rep_n_removed").alias("n_removed"),
        F.sha2("rep_kept", 256).alias("kept_sha256"),
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_passages(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id",
        F.col("bench_n_words").alias("n_words"),
        decontamination.hit_words().alias("n_hit"),
        F.size("bench_item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_item_ids", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


@query(sql=licenses.check_sql())
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence or licence notice in each document that is most like a standard text."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.col("lic_name").alias("license"), F.col("lic_dice").alias("dice"))


@query
def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extraction.extract(pages, "url", "html")
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar to 0.8 or more."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", size=2)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that each document is good and that it is toxic, from its words, source and language within it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs, "doc_id", "text", "source", "lang", labels, ["quality", "toxic"])
    keep = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return scored.drop("source", "lang").withColumn("keep", keep)


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a network that has seen three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_hash("doc_id") % 4 == 2
    net = language.train(docs.where(~held_out), "doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), "text", net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_hash("doc_id") % 5 == 1
    model = language_model.fit(docs.where(~held_out), "text")
    scored = language_model.score(docs.select("doc_id", "text"), "text", model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("lm_tokens").alias("n_tokens"),
        F.col("lm_known").alias("n_known"),
        language_model.train_tokens(model).alias("train_tokens"),
        F.col("lm_base_score").alias("base_score"),
        F.col("lm_score").alias("score"),
    )


@query(sql=divergence.check_sql())
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of each source from the others of its language, and its own terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), "text", "lang", "source")


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in few sequences of 1024 tokens."""
    path = tokenizer_path("byte_bpe_50k.json")
    pieces = swap_packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")


@query(sql=hard_negatives.check_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "vec_id", "embedding", "label", F.col("id") % 50 == 0)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of `corpus_pipeline` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
