"""Plug points for models: each wraps a batch callable into a Spark operator.

The callable is built once per Python worker by a factory, never per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def embedder(load: Callable[[], Callable[[pd.Series], list]]):
    """Column function text -> ``array<float>``; ``load()`` returns a batch encoder."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts)))

    return encode


def pair_scorer(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]):
    """Column function (query, passage) -> double for ``rerank_topk``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for left, right in batches:
            yield pd.Series(model(left, right)).astype("float64")

    return score


def language_detector(load: Callable[[], Callable[[pd.Series], pd.Series]]):
    """Column function text -> language code."""

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts)).astype("object")

    return detect


def generate(
    prompts: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: StructType,
    validate: str,
) -> DataFrame:
    """Run a batch generator over a prompt table.

    ``load()`` returns a function from a prompt batch to a response batch in
    ``schema``.  Rows failing the SQL predicate ``validate`` keep their response
    and are marked in ``quarantined``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)[schema.names]

    ok = F.coalesce(F.expr(validate), F.lit(False))
    return prompts.mapInPandas(run, schema).withColumn("quarantined", ~ok)
