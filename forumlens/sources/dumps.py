"""Monthly JSON dumps of communities, submissions and comments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumlens.sources.tables import with_source_file
from forumlens.sources.xz import read_xz_lines

# Field names and types of the dump records.
COMMUNITY_SCHEMA = (
    "id STRING, name STRING, display_name STRING, title STRING, url STRING, subscribers BIGINT, "
    "subreddit_type STRING, description STRING, lang STRING, over18 BOOLEAN"
)
SUBMISSION_SCHEMA = (
    "subreddit_id STRING, subreddit STRING, id STRING, permalink STRING, score BIGINT, title STRING, "
    "selftext STRING, url STRING, author STRING, author_fullname STRING, created_utc BIGINT, over_18 BOOLEAN"
)
COMMENT_SCHEMA = (
    "subreddit_id STRING, subreddit STRING, link_id STRING, id STRING, parent_id STRING, permalink STRING, "
    "score BIGINT, body STRING"
)
CORRUPT = "_corrupt_record"


NOT_XZ = "{*[!z],*[!x]z}"  # names that do not end in xz


def xz_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The .xz files at some paths: files, folders or patterns. Only names are listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(list(paths)).select("path")
    return sorted(r.path for r in found.collect())


def parsed(lines: DataFrame, fields: StructType) -> DataFrame:
    """JSON records of (value, source_file) lines; a line that is no JSON is kept in `_corrupt_record`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    some = lines.where(F.trim("value") != "")
    record = some.select(F.from_json("value", fields, options).alias("r"), "source_file")
    return record.select("r.*", "source_file")


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """NDJSON records (plain, .gz, .bz2, .zst or .xz) with their source file.

    `path` is a file, a folder or a pattern, and may hold files of all kinds.
    The schema is always given, so only named fields are parsed and nothing is
    read twice to infer types. Lines that are no JSON come back as null rows
    with their text in `_corrupt_record`.

    An .xz file is read with a task for each of its blocks (`sources.xz`), so
    one huge dump is spread over the cluster. A file of another codec is one
    split, parsed by one task: filter it and write the rows as parquet once
    (`tables.load_or_compute`, or the file stream) before any text work.
    """
    return read_dumps(spark, [path], schema)


def read_dumps(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """`read_dump` of several paths."""
    fields = StructType.fromDDL(schema).add(CORRUPT, "string")
    xz = xz_paths(spark, paths)
    others = [p for p in paths if not p.endswith(".xz")]
    found = [parsed(read_xz_lines(spark, xz), fields)] if xz else []
    if others:
        reader = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        found.append(with_source_file(reader.option("pathGlobFilter", NOT_XZ).json(others)))
    if not found:
        raise FileNotFoundError(f"no dump at {list(paths)}")
    return reduce(DataFrame.unionByName, found)


def nested_field(document, path: str):
    """A field of a JSON document, e.g. `$.data.description`."""
    return F.get_json_object(document, path)
