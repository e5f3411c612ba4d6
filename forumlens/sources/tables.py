"""Reading and writing tables: parquet, JDBC, CSV."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from forumlens.operators.ranking import row_index


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table (one file or a folder of files, concatenated), read as it lies."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that is no larger than one split over the cores.

    A row group cannot be split, so costly work on such a file would be one
    task. What moves is one split at most; any larger table stays as it lies.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    one_split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(plan.stats().sizeInBytes()) <= one_split
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def with_source_file(df: DataFrame, column: str = "source_file") -> DataFrame:
    """The name of the file each row came from. Apply right after the read."""
    return df.withColumn(column, F.col("_metadata.file_name"))


def scrub_nul(df: DataFrame) -> DataFrame:
    """Drop NUL characters from every string column; databases reject them."""
    return df.select(
        *[
            F.translate(F.col(f.name), "\0", "").alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    **properties: str,
) -> DataFrame:
    """A database table over JDBC; filters and column lists are pushed down.

    Give a partition column with its range for large tables: without one the
    whole table is read by a single task.
    """
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    )


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", batch_rows: int = 100_000, **properties):
    """Append to or replace a database table, NUL-free, in batches."""
    scrub_nul(df).write.mode(mode).jdbc(url, table, properties={**properties, "batchsize": str(batch_rows)})


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "append",
    index_label: str | None = None,
    index_key: str | None = None,
) -> None:
    """Append to or replace a parquet table, NUL-free.

    `index_label` adds a 0-based row number in the order of the unique column
    `index_key`.
    """
    df = scrub_nul(df)
    if index_label is not None:
        df = row_index(df, index_key, index_label)
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def artefact_path(root: str, kind: str, **parameters) -> str:
    """One folder per artefact and parameter set, e.g. `root/tfidf/max_df=0.6/min_df=10`."""
    return "/".join([root, kind, *[f"{k}={parameters[k]}" for k in sorted(parameters)]])


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at `path`; if it is missing or its write was never finished, make it first."""
    if not finished(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """A write to this folder has ended: only then is there its success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def load_or_fit(path: str, load: Callable[[str], object], fit: Callable[[], object]):
    """The same for a fitted ML model: `load` is e.g. `KMeansModel.load`."""
    try:
        return load(path)
    except Exception as missing:  # the loaders raise different types for a missing path
        if "PATH_NOT_FOUND" not in str(missing) and "does not exist" not in str(missing):
            raise
        model = fit()
        model.write().overwrite().save(path)
        return model
