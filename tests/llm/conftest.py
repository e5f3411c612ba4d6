"""Small tables with odd rows: nulls, empty and long texts, ties, repeated rows, extra columns."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tables import DOCS, PASSAGE, SF, odd_rows, odd_vectors  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """Given tables with the odd documents added (but those without an id of their own)."""
    path = str(tmp_path_factory.mktemp("tables"))
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    more = odd.where("doc_id is not null and text not like 'another%' or text is null").dropDuplicates(["doc_id"])
    own.unionByName(more.select(*own.columns)).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame([(900, "two words"), (901, None), (902, " ; "), (903, PASSAGE)], "item_id long, text string")
    spark.read.parquet(f"{SF}/benchmark.parquet").union(items).write.parquet(f"{path}/benchmark.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd_pages = spark.createDataFrame([(9_000, None, None), (9_001, "no address", "<p>a"), (9_002, "", "")], pages.schema)
    pages.union(odd_pages).write.parquet(f"{path}/pages.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors.union(spark.createDataFrame(odd_vectors(), vectors.schema)).write.parquet(f"{path}/embeddings.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.withColumn("quality", F.when(F.col("doc_id") % 7 > 0, F.col("quality"))).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def none(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "benchmark", "pages", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="session")
def documents(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
