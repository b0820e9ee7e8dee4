"""Class probabilities as arrays in the row: no shuffle per prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits: Column | str, temperature: float | Column = 1.0) -> Column:
    """Max-shifted softmax of ``logits / max(0.01, T)``."""
    z = _col(logits)
    t = F.greatest(F.lit(0.01), temperature if isinstance(temperature, Column) else F.lit(float(temperature)))
    top = F.array_max(z)
    parts = F.transform(z, lambda v: F.exp((v - top) / t))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(parts, lambda v: v / total)


def log_loss(logits: Column | str, label: Column | str, temperature: Column | float) -> Column:
    """``-ln clip(p_label, 1e-12, 1)`` without building the whole softmax."""
    z = _col(logits)
    t = F.greatest(F.lit(0.01), temperature if isinstance(temperature, Column) else F.lit(float(temperature)))
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / t))
    p = F.exp((F.get(z, _col(label)) - top) / t) / total
    return -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))


def argmax(values: Column | str) -> Column:
    """Zero-based position of the largest value, the first on ties."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")


def threshold_argmax(probs: Column | str, thresholds: Sequence[float] | None) -> Column:
    """Argmax of ``p / clip(t, 1e-5, 1)``; plain argmax when the sizes differ."""
    p = _col(probs)
    if thresholds is None:
        return argmax(p)
    clipped = F.array(*[F.lit(min(max(float(t), 1e-5), 1.0)) for t in thresholds])
    scaled = F.zip_with(p, clipped, lambda a, b: a / b)
    return F.when(F.size(p) == len(thresholds), argmax(scaled)).otherwise(argmax(p))


def ranked(probs: Column | str) -> Column:
    """``array<struct<neg_p, k>>`` from most to least probable, low index first on ties."""
    pairs = F.transform(
        _col(probs), lambda p, i: F.struct((-p).alias("neg_p"), i.cast("bigint").alias("k"))
    )
    return F.array_sort(pairs)


def secondary(probs: Column | str, floor: float = 0.15) -> Column:
    """Class positions ranked second and third with ``p > floor``."""
    runners_up = F.slice(ranked(probs), 2, 2)
    return F.transform(F.filter(runners_up, lambda x: -x["neg_p"] > floor), lambda x: x["k"])


def prediction_set(probs: Column | str, q_hat: Column | float) -> Column:
    """Class positions with ``1 - p <= q_hat``."""
    q = q_hat if isinstance(q_hat, Column) else F.lit(float(q_hat))
    marked = F.transform(
        _col(probs), lambda p, i: F.when(1.0 - p <= q, i.cast("bigint"))
    )
    return F.filter(marked, lambda k: k.isNotNull())
