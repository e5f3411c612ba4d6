"""Deterministic ordering keys and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence locations (code, name, term prefix).
LOCATIONS = [
    (0, "subreddit", "sss"),
    (1, "post_title", "ttt"),
    (2, "post_description", "ddd"),
    (3, "comment_1", "ccc"),
    (4, "comment_2", "ccc"),
    (5, "comment_3", "ccc"),
    (6, "comment_4", "ccc"),
    (7, "comment_5", "ccc"),
]


def draw_key(seed: int | Column, key: Column) -> Column:
    """A random-looking but repeatable sort key: md5 of `seed:key`.

    The same on every engine, partitioning and run, and evenly spread, so its
    leading characters split any group into equal parts.
    """
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def location_prefix(code: Column) -> Column:
    pairs = []
    for number, _, prefix in LOCATIONS:
        pairs += [F.lit(number), F.lit(prefix)]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))
