"""Calibration of class probabilities: temperature, thresholds, conformal quantile, costs.

Every fit is a few aggregates over the data.  Only bounded summaries (a grid of
losses, a histogram, a confusion table) ever leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ticketloom.config import CostSettings
from ticketloom.functions.probability import argmax, log_loss


# ---------------------------------------------------------- temperature


def temperature_curve(df: DataFrame, logits: str, label: str, grid: Column) -> DataFrame:
    """``(t, nll)`` for every temperature of an array column; combines map-side."""
    return (
        df.select(logits, label, F.explode(grid).alias("t"))
        .groupBy("t")
        .agg(F.avg(log_loss(logits, label, F.col("t"))).alias("nll"))
    )


def coarse_grid() -> Column:
    """0.05, 0.10 ... 5.00"""
    return F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i * 0.05)


def _slopes(df: DataFrame, logits: str, label: str, b: float) -> tuple[float, float] | None:
    """First and second derivative of the mean loss by b = 1 / temperature: one aggregate."""
    z, top = F.col(logits), F.array_max(logits)

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    weights = F.transform(z, lambda x: F.exp((x - top) * b))
    rows = df.select(z.alias("z"), F.get(z, F.col(label).cast("int")).alias("own"), weights.alias("w"))
    rows = rows.select("own", "z", "w", total(F.col("w")).alias("sum"))
    mean = total(F.zip_with("w", "z", lambda w, x: w * x)) / F.col("sum")
    square = total(F.zip_with("w", "z", lambda w, x: w * x * x)) / F.col("sum")
    first = rows.select((mean - F.col("own")).alias("d"), (square - mean * mean).alias("dd"))
    r = first.agg(F.avg("d").alias("d"), F.avg("dd").alias("dd")).first()
    return None if r["d"] is None else (r["d"], r["dd"])


def temperature_fit(df: DataFrame, logits: str, label: str) -> DataFrame:
    """One row ``(temperature, nll)``: best temperature in [0.05, 5] among multiples of 0.001.

    The mean loss is convex in 1 / temperature.  Newton's method, kept inside a
    bracket, finds its minimum in a few aggregates of two numbers; the multiples around it are compared.
    """
    lo, hi, b = 1 / 5.0, 1 / 0.05, 1.0
    for _ in range(60):
        slopes = _slopes(df, logits, label, b)
        if slopes is None:
            break
        d, dd = slopes
        lo, hi = (b, hi) if d < 0 else (lo, b)
        new = b - d / dd if dd > 0 else (lo + hi) / 2
        if not lo < new < hi:
            new = (lo + hi) / 2
        done = abs(1 / new - 1 / b) < 1e-5
        b = new
        if done:
            break
    k = round(1000 / b)
    near = sorted({min(5.0, max(0.05, i / 1000)) for i in (k - 1, k, k + 1)})
    curve = temperature_curve(df, logits, label, F.array(*map(F.lit, near)))
    return curve.agg(F.min_by("t", F.struct(F.round("nll", 12), "t")).alias("temperature"), F.min("nll").alias("nll"))


# ----------------------------------------------------- class thresholds


def _macro_f1(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro F1 per key over the labels seen as truth or prediction."""
    sides = F.explode(
        F.array(
            F.struct(
                F.col("y").alias("label"),
                F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                F.col("n").alias("weight"),
            ),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("weight")),
        )
    )
    per_label = (
        confusion.select(*keys, sides.alias("s"))
        .groupBy(*keys, "s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.weight").alias("weight"))
    )
    # 2 tp / (2 tp + fp + fn): the weight counts every true row and every prediction
    return per_label.groupBy(*keys).agg(F.avg(2 * F.col("tp") / F.col("weight")).alias("macro_f1"))


def class_threshold_sweep(
    df: DataFrame, probs: str, label: str, thresholds: Sequence[float], position: int,
    candidates: Sequence[float],
) -> DataFrame:
    """``(candidate, macro_f1)`` when one class's divisor takes each candidate value."""
    def clip(t: float) -> float:
        return min(max(float(t), 1e-5), 1.0)

    options = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("candidate"),
                F.array(*[F.lit(clip(c if i == position else t)) for i, t in enumerate(thresholds)]).alias("t"),
            )
            for c in candidates
        ]
    )
    scaled = F.zip_with(F.col(probs), F.col("x.t"), lambda p, t: p / t)
    confusion = (
        df.select(F.col(label).cast("bigint").alias("y"), probs, F.explode(options).alias("x"))
        .select(F.col("x.candidate").alias("candidate"), "y", argmax(scaled).alias("pred"))
        .groupBy("candidate", "y", "pred")
        .agg(F.count("*").alias("n"))
    )
    return _macro_f1(confusion, ["candidate"])


def class_threshold_fit(
    df: DataFrame,
    probs: str,
    label: str,
    n_classes: int,
    candidates: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    rounds: int | None = None,
) -> tuple[list[float], list[float]]:
    """Per-class divisors in [0.1, 0.9] by coordinate ascent, starting from 0.5.

    One aggregate per class and round; the macro F1 never falls.  Rounds go on until one
    changes nothing (or ``rounds`` are over).  Returns the divisors and the F1 after each step.
    """
    thresholds, history = [0.5] * n_classes, []
    before, done = None, 0
    while thresholds != before and done != rounds:
        before, done = list(thresholds), done + 1
        for position in range(n_classes):
            curve = class_threshold_sweep(df, probs, label, thresholds, position, candidates)
            scores = {r["candidate"]: round(r["macro_f1"], 12) for r in curve.collect()}
            best = max(scores.values())
            current = thresholds[position]
            if best > scores.get(current, -1.0):
                thresholds[position] = min(c for c, v in scores.items() if v == best)
            history.append(max(best, scores.get(current, best)))
    return thresholds, history


# ------------------------------------------------------------ conformal

_HISTOGRAM = 4096


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """Exact values at some ranks (from 0), by histograms that narrow the interval around each.

    A round leaves at most 4,096 counts and ends of buckets, so no task and no driver ever holds the values.
    """
    v = F.col(value)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    open_ = {r: (lo, hi, r) for r in ranks}  # interval, and rank within it
    while wide := {(lo, hi) for lo, hi, _ in open_.values() if lo < hi}:
        for lo, hi in wide:
            width = (hi - lo) / _HISTOGRAM
            bucket = F.least(F.floor((v - lo) / width), F.lit(_HISTOGRAM - 1)) if width > 0 and lo + width > lo else v
            counts = (
                df.filter((v >= lo) & (v <= hi))
                .groupBy(bucket.alias("b"))
                .agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
                .collect()
            )
            counts.sort(key=lambda r: r["lo"])
            for rank, (a, z, left) in list(open_.items()):
                if (a, z) == (lo, hi):
                    for r in counts:
                        if left < r["n"]:
                            open_[rank] = (r["lo"], r["hi"], left)
                            break
                        left -= r["n"]
    return [open_[r][0] for r in ranks]


def interpolated_quantile(df: DataFrame, value: str, share: float, n: int) -> float:
    """Exact quantile with linear interpolation between order statistics."""
    position = share * (n - 1)
    at = math.floor(position)
    low, high = order_statistics(df, value, [at, min(at + 1, n - 1)])
    return low + (high - low) * (position - at)


def conformal_quantile(df: DataFrame, p_true: str, alpha: float = 0.05) -> DataFrame:
    """One row ``(alpha, n, level, q_hat)`` from the probability of the true class."""
    scores = df.select((1.0 - F.col(p_true)).alias("s"))
    n = scores.count()
    level = min(1.0, math.ceil((n + 1) * (1.0 - alpha)) / n)
    q_hat = interpolated_quantile(scores, "s", level, n)
    return df.sparkSession.createDataFrame(
        [(float(alpha), n, level, float(q_hat))], "alpha double, n bigint, level double, q_hat double"
    )


SKETCH_K = 400  # size of a sketch; its rank error is below ``SKETCH_ERROR`` in 99 of 100 cases
SKETCH_ERROR = 0.01


def score_sketches(df: DataFrame, p_true: str, *keys: str) -> DataFrame:
    """``(keys, n, sketch)``: a mergeable quantile sketch of the scores 1 - p of each group, to be stored as a table."""
    rows = df.filter(F.col(p_true).isNotNull()).select(*keys, (1.0 - F.col(p_true)).alias("s"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("s", F.lit(SKETCH_K)).alias("sketch"))


def sketched_quantile(sketches: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``(alpha, n, level, q_hat)`` as :func:`conformal_quantile`, approximately, from stored sketches without the rows.

    The rank of ``q_hat`` is off the level by at most ``SKETCH_ERROR`` of the rows.  Without sketches there is no row.
    """
    n = sketches.agg(F.sum("n")).first()[0] or 0
    level = min(1.0, math.ceil((n + 1) * (1.0 - alpha)) / n) if n else 1.0  # a quantile's rank must be a literal
    whole = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch")).filter(F.lit(n) > 0)
    return whole.select(
        F.lit(float(alpha)).alias("alpha"), F.lit(n).cast("long").alias("n"), F.lit(level).alias("level"),
        F.kll_sketch_get_quantile_double("sketch", F.lit(level)).alias("q_hat"),
    )


def conformal_coverage(gated: DataFrame, label: str) -> DataFrame:
    """One row: coverage, singleton share, error on singletons, empty share."""
    hit = F.array_contains("prediction_set", F.col(label).cast("bigint"))
    single = F.col("set_size") == 1
    return gated.agg(
        F.count("*").alias("n"),
        F.avg(hit.cast("double")).alias("coverage"),
        F.avg(single.cast("double")).alias("singleton_share"),
        F.avg(F.when(single, (~hit).cast("double"))).alias("singleton_error"),
        F.avg((F.col("set_size") == 0).cast("double")).alias("empty_share"),
    )


# ----------------------------------------------------------- cost sweep


def _grid_index(p: Column, step: float) -> Column:
    """Largest i with ``i * step <= p``, robust against rounding of the product."""
    i = F.floor(p / step)
    return (
        F.when((i + 1) * step <= p, i + 1).when(i * step > p, i - 1).otherwise(i)
    ).cast("bigint")


def cost_curve(
    df: DataFrame, max_p: str, escalate: str, costs: CostSettings = CostSettings()
) -> DataFrame:
    """Cost of each of the 101 thresholds: ``(t, false_auto_handles, false_escalations, ...)``.

    The rows are reduced to a histogram of 101 buckets first; running sums over
    the buckets give every threshold, so the data is read once and never blown up.
    """
    counts = df.groupBy(_grid_index(F.col(max_p), 0.01).alias("i")).agg(
        F.count_if(F.col(escalate)).alias("pos"), F.count_if(~F.col(escalate)).alias("neg")
    )
    buckets = df.sparkSession.range(101).withColumnRenamed("id", "i").join(counts, "i", "left")
    up = W.orderBy("i")
    swept = buckets.fillna(0, ["pos", "neg"]).select(
        (F.col("i") * 0.01).alias("t"),
        F.sum("pos").over(up.rowsBetween(0, W.unboundedFollowing)).alias("false_auto_handles"),
        F.coalesce(F.sum("neg").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("false_escalations"),
        F.sum(F.col("pos") + F.col("neg")).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    total = F.col("false_auto_handles") * costs.false_auto_handle + F.col("false_escalations") * costs.false_escalation
    return swept.withColumn("total_cost", total).withColumn(
        "avg_cost_per_ticket", F.col("total_cost") / F.col("n")
    ).drop("n")


def cost_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest threshold, the lowest one on ties."""
    return curve.orderBy("total_cost", "t").limit(1).withColumnRenamed("t", "optimal_threshold")


# ----------------------------------------------------------- focal loss


def focal_loss(p_true: Column | str, gamma: float = 2.0, weight: Column | None = None) -> Column:
    p = F.greatest(F.col(p_true) if isinstance(p_true, str) else p_true, F.lit(1e-12))  # ln(0) would be null
    loss = F.pow(1.0 - p, F.lit(float(gamma))) * -F.log(p)
    return loss if weight is None else weight * loss
