"""Running counts and gap sessions that do not put a whole key in one task.

A key's rows are cut into ordered buckets (a day, a block of turns).  Totals
per bucket are small and carry the running state from one bucket to the next;
the rows themselves are only ever sorted within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    out: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``out``: rows (or summed ``weight``) of the key up to and including this row."""
    keys, order = list(keys), list(order)
    weight = F.lit(1) if weight is None else weight
    marked = df.withColumn("_bucket", bucket).withColumn("_weight", weight)
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        marked.withColumn("_bucket", F.coalesce(F.col("_bucket").cast("string"), F.lit("")))
        .join(carried.withColumn("_bucket", F.coalesce(F.col("_bucket").cast("string"), F.lit(""))), [*keys, "_bucket"])
        .withColumn(out, F.col("_carried") + F.sum("_weight").over(within))
        .drop("_bucket", "_weight", "_carried")
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, columns: Sequence[str]
) -> DataFrame:
    """Add ``prev_<c>`` for each column: its value in the key's preceding row."""
    keys, order, columns = list(keys), list(order), list(columns)
    marked = df.withColumn("_bucket", bucket)
    value = F.struct(*columns)
    last = marked.groupBy(*keys, "_bucket").agg(
        F.max_by(value, F.struct(*order)).alias("_last")
    )
    by_bucket = W.partitionBy(*keys).orderBy("_bucket")
    carried = last.withColumn("_before", F.lag("_last").over(by_bucket)).drop("_last")
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = marked.join(carried, [*keys, "_bucket"]).withColumn(
        "_prev", F.coalesce(F.lag(value).over(within), F.col("_before"))
    )
    for c in columns:
        joined = joined.withColumn(f"prev_{c}", F.col(f"_prev.{c}"))
    return joined.drop("_bucket", "_before", "_prev")


def gap_sessions(
    df: DataFrame, key: str, ts: str, tiebreak: str, gap: str, bucket: Column
) -> DataFrame:
    """Add ``session_no``, counting from 1 per key; a new session starts after ``gap``."""
    linked = previous_row(df, [key], [ts, tiebreak], bucket, [ts])
    starts = F.when(
        F.col(f"prev_{ts}").isNull() | (F.col(ts) >= F.col(f"prev_{ts}") + F.expr(f"interval {gap}")),
        1,
    ).otherwise(0)
    return running_count(linked, [key], [ts, tiebreak], bucket, "session_no", starts).drop(f"prev_{ts}")
