"""Run summaries: one long table, exported as nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per (keys, metric) from one column per metric."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def nested_summary(long: DataFrame, run_keys: Sequence[str], model_keys: Sequence[str]) -> DataFrame:
    """One JSON document per run with the list of its models and their metrics.

    Metrics per model and models per run are the sizes of the parameter grid,
    not of the data.
    """
    models = long.groupBy(*run_keys, *model_keys).agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("entries"))
    rows = F.sort_array(F.collect_list(F.struct(*model_keys, "entries")))  # a map cannot be sorted, its entries can
    listed = F.transform(
        rows, lambda r: F.struct(*(r[k].alias(k) for k in model_keys), F.map_from_entries(r["entries"]).alias("metrics"))
    )
    return models.groupBy(*run_keys).agg(F.to_json(listed).alias("models"))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The metrics of `new` added to those of `old`; of the same keys and metric the new value counts."""
    kept = old.join(new.select(*keys, "metric"), [*keys, "metric"], "left_anti")
    return kept.select(*keys, "metric", "value").unionByName(new.select(*keys, "metric", "value"))
