"""Joins that keep one very frequent key from landing in a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ticketloom.session import materialize


def hot_keys(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """``(key, parts)`` for every key with more than ``rows_per_task`` rows."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > rows_per_task)
        .select(key, F.ceil(F.col("n") / rows_per_task).cast("int").alias("parts"))
    )


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``key``), splitting frequent keys of ``left``.

    Rows of a frequent key are spread over several tasks by a hash of
    ``spread_by``; only the matching row of ``right`` is repeated.
    """
    # written once: both sides read it, and its size decides how it is joined
    hot = materialize(hot_keys(left, key, rows_per_task), "hot-keys")
    salted_left = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("parts", F.lit(1))).cast("int"))
        .drop("parts")
    )
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .drop("parts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
