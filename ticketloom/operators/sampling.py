"""Samples and splits that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ticketloom.functions.text import stable_order
from ticketloom.operators.running import running_count
from ticketloom.session import materialize


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement; a top-n, not a full sort."""
    return df.orderBy(stable_order(id_col, seed), id_col).limit(n)


def head_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


BUCKET_ROWS = 20_000


def shuffled_position(df: DataFrame, keys: list[str], id_col: str, seed: int, out: str, most: int | None = None) -> DataFrame:
    """Add ``out``: 1-based position within the keys in hash order, with no large single-task sort.

    ``most``: rows of the largest key, counted if not given; a key's rows are dealt into as many buckets of the
    hash as keep a bucket near ``BUCKET_ROWS``.
    """
    if most is None:
        most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(most / BUCKET_ROWS, 1), 16)))
    ordered = df.withColumn("_h", stable_order(id_col, seed))
    return running_count(ordered, keys, ["_h", id_col], F.substring("_h", 1, digits), out).drop("_h")


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_share: float = 0.25, seed: int = 42
) -> DataFrame:
    """Add ``split``: the first ``ceil(share * count)`` of each label in hash order are "test"."""
    # one row per label; as a written table its size decides that the join is a broadcast
    sizes = materialize(df.groupBy(label).agg(F.count("*").alias("_n")), "label-sizes")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    placed = shuffled_position(df, [label], id_col, seed, "_pos", most).join(sizes, label)
    in_test = F.col("_pos") <= F.ceil(F.col("_n") * test_share)
    return placed.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_pos", "_n")
