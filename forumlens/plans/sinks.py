"""Queries: the given tables written by a sink and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import filters
from forumlens.plans.registry import query
from forumlens.plans.views import table
from forumlens.session import new_path
from forumlens.sources import tables, xz
from forumlens.sources.dumps import read_dump
from forumlens.streaming.dumps import append_new_dumps

DUMP_SCHEMA = "doc_id BIGINT, text STRING, lang STRING"


def dumped(spark, folder, **options):
    """Documents as an NDJSON dump in the shared folder."""
    path = new_path(spark, "dump")
    table(spark, folder, "documents", "doc_id", "text", "lang").write.options(**options).json(path)
    return path


@query("S1", sql="SELECT doc_id, text, lang FROM documents")
def ndjson_scan(spark, folder):
    return read_dump(spark, dumped(spark, folder), DUMP_SCHEMA).select("doc_id", "text", "lang")


@query("S3", sql="SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def compressed_ndjson_scan(spark, folder):
    dump = read_dump(spark, dumped(spark, folder, compression="gzip"), DUMP_SCHEMA)
    return dump.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def xz_dumped(spark, folder):
    """Documents as an NDJSON dump in .xz files of many blocks."""
    path = new_path(spark, "xz-dump")
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    xz.write_xz_lines(docs.select(F.to_json(F.struct("doc_id", "text", "lang"))), path, block_bytes=1 << 20)
    return path


@query("S3", sql="SELECT doc_id, text, lang FROM documents")
def xz_scan(spark, folder):
    """Read with a task for each block of the files."""
    return read_dump(spark, xz_dumped(spark, folder), DUMP_SCHEMA).select("doc_id", "text", "lang")


@query("S5", "C6", sql="SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey, o_orderpriority FROM orders")
def table_sink_with_index(spark, folder):
    path = new_path(spark, "orders")
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    tables.write_table(orders, path, "overwrite", index_label="row_index", index_key="o_orderkey")
    return spark.read.parquet(path).select("row_index", "o_orderkey", "o_orderpriority")


@query("S10", sql="SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_sink(spark, folder):
    path = new_path(spark, "customers")
    tables.write_csv(table(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal"), path)
    schema = "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE"
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


@query("S6", sql="SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def reusable_artefact(spark, folder):
    """Computed and saved by the first call, read by the second."""
    path = tables.artefact_path(new_path(spark, "artefacts"), "counts", seed=1, n_posts=100)

    def compute():
        return table(spark, folder, "documents", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("n"))

    tables.load_or_compute(spark, path, compute)
    return tables.load_or_compute(spark, path, compute)


KEPT_POSTS = "SELECT doc_id, lang, text FROM documents WHERE lang = 'en' AND lower(text) NOT IN ('deleted', 'removed')"


def streamed(spark, dump):
    """A file stream that filters the files of a dump and appends them to a table."""
    output = new_path(spark, "stream-out")

    def rules(batch):
        kept = batch.where((F.col("lang") == "en") & filters.not_marker(F.col("text"), ["deleted", "removed"]))
        return kept.select("doc_id", "lang", "text")

    append_new_dumps(spark, dump, DUMP_SCHEMA, rules, output, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(output).select("doc_id", "lang", "text")


@query("X1", sql=KEPT_POSTS)
def stream_of_dumps(spark, folder):
    return streamed(spark, dumped(spark, folder))


@query("X1", "S3", sql=KEPT_POSTS)
def stream_of_xz_dumps(spark, folder):
    return streamed(spark, xz_dumped(spark, folder))
