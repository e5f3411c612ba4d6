"""Dumps as a file stream: new files are filtered and appended, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from forumlens.sources.dumps import read_dumps
from forumlens.sources.tables import write_table


def append_new_dumps(
    spark: SparkSession,
    folder: str,
    schema: str,
    rules: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Filter all dump files not seen before and append the rows to a parquet table.

    The stream is one of file names; a batch reads its files with `read_dump`,
    so all codecs and .xz are taken alike. The filters keep no state between
    batches. Each batch writes its own folder `batch=<id>` in overwrite mode,
    so a batch repeated after a failure replaces its first attempt and no row
    is appended twice. Lines that are no JSON are null rows with their text in
    `_corrupt_record`; the rules decide about them.
    """
    files = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    names = spark.readStream.format("binaryFile").schema(files).load(folder).select("path")

    def write(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]  # of this batch's files only
        records = read_dumps(spark, paths, schema)
        write_table(rules(records), f"{output}/batch={batch_id}", mode="overwrite")

    return (
        names.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
