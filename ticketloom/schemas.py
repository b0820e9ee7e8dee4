"""Explicit schemas of the tables that cross a storage boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TWEETS_CSV = _strings(
    "tweet_id", "author_id", "inbound", "created_at", "text",
    "response_tweet_id", "in_response_to_tweet_id",
)

CORPUS = _strings("passage_id", "brand", "customer_query", "historical_resolution")

OPENINGS = _strings("thread_id", "customer_tweet_id", "customer_query", "created_at")

PARAMS = T.StructType(
    [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("thresholds", T.ArrayType(T.DoubleType())),
        T.StructField("best_val_macro_f1", T.DoubleType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("q_hat", T.DoubleType()),
    ]
)

VECTOR = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))]
)

CONTEXT_ITEM = T.StructType(
    [
        T.StructField("passage_id", T.StringType()),
        T.StructField("customer_query", T.StringType()),
        T.StructField("historical_resolution", T.StringType()),
        T.StructField("intent", T.StringType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("lexical_score", T.DoubleType()),
        T.StructField("rerank_score", T.DoubleType()),
    ]
)
