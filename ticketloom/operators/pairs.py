"""Selection of text pairs for the encoders trained elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.functions import text as X
from ticketloom.operators.sampling import shuffled_position
from ticketloom.session import materialize


def contrastive_pairs(corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """All (query, resolution) pairs longer than 10 characters each; the first ``limit`` by id if one is given."""
    clean = corpus.select(
        "passage_id",
        X.normalize_text("customer_query").alias("anchor"),
        X.normalize_text("historical_resolution").alias("positive"),
    )
    long = clean.filter((F.length("anchor") > 10) & (F.length("positive") > 10))
    return long if limit is None else long.orderBy("passage_id").limit(limit)


def labelled_pairs(df: DataFrame, id_col: str, label: str, iterations: int = 20, seed: int = 42) -> DataFrame:
    """``(a, b, same)``: per text up to ``iterations`` partners with its label and as many without.

    Texts get a position in hash order; the j-th partner is found by position,
    so the work is linear in the number of pairs kept and no label is paired
    with itself in full.
    """
    placed = shuffled_position(
        df.select(F.col(id_col).alias("a"), F.col(label).alias("label")), ["label"], "a", seed, "i"
    ).withColumn("i", F.col("i") - 1)
    # one row per label; as a written table its size decides that the join is a broadcast.
    sizes = placed.groupBy("label").agg(F.count("*").alias("n"))
    before = W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)
    blocks = materialize(
        sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "label-blocks"
    )
    total = df.agg(F.count("*").alias("n")).scalar()
    base = placed.join(blocks, "label").withColumn("others", total - F.col("n"))
    slots = base.select("a", (F.col("start") + F.col("i")).alias("slot"))

    def steps(limit):
        return F.explode(F.when(limit >= 1, F.sequence(F.lit(1), limit.cast("int"))))

    same = base.withColumn("j", steps(F.least(F.lit(iterations), F.col("n") - 1))).select(
        "a",
        (F.col("start") + (F.col("i") + F.col("j")) % F.col("n")).alias("slot"),
        F.lit(True).alias("same"),
    )
    skip = (F.col("i") * iterations + F.col("j") - 1) % F.col("others")
    other = base.withColumn("j", steps(F.least(F.lit(iterations), F.col("others")))).select(
        "a",
        F.when(skip < F.col("start"), skip).otherwise(skip + F.col("n")).alias("slot"),
        F.lit(False).alias("same"),
    )
    partners = slots.withColumnRenamed("a", "b")
    return same.unionByName(other).join(partners, "slot").select("a", "b", "same")
