"""Rank fusion, re-ranking, diversity and the semantic cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ticketloom.config import CacheSettings, RetrievalSettings
from ticketloom.functions import text as X
from ticketloom.operators.dense import dense_topk

_TIE = 9


def candidate_union(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Distinct ``(q, doc)`` of both candidate lists."""
    return dense.select("q", "doc").union(lexical.select("q", "doc")).distinct()


def rrf_fuse(
    dense: DataFrame, lexical: DataFrame, settings: RetrievalSettings = RetrievalSettings()
) -> DataFrame:
    """Reciprocal rank fusion of two ``(q, doc, score, rank)`` lists.

    ``(q, doc, similarity_score, lexical_score, rrf_score, rank)``; a missing
    side adds nothing and reports 0.
    """
    d = dense.select("q", "doc", F.col("score").alias("d_score"), F.col("rank").alias("d_rank"))
    b = lexical.filter(F.col("score") > 0).select(
        "q", "doc", F.col("score").alias("b_score"), F.col("rank").alias("b_rank")
    )
    share_d = F.coalesce(settings.dense_weight / (settings.rrf_k + F.col("d_rank")), F.lit(0.0))
    share_b = F.coalesce(settings.bm25_weight / (settings.rrf_k + F.col("b_rank")), F.lit(0.0))
    fused = d.join(b, ["q", "doc"], "full_outer").select(
        "q",
        "doc",
        F.coalesce("d_score", F.lit(0.0)).alias("similarity_score"),
        F.coalesce("b_score", F.lit(0.0)).alias("lexical_score"),
        (share_d + share_b).alias("rrf_score"),
    )
    w = W.partitionBy("q").orderBy(F.desc(F.round("rrf_score", 12)), "doc")
    return fused.withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= settings.fused_k
    )


def attach_passages(fused: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the passage text; a corpus without intents reports "general"."""
    passages = corpus.withColumnRenamed("passage_id", "doc")
    if "intent" not in passages.columns:
        passages = passages.withColumn("intent", F.lit("general"))
    return fused.join(
        passages.select("doc", "customer_query", "historical_resolution", "intent"), "doc"
    )


def token_jaccard(left: Column | str, right: Column | str) -> Column:
    """Default pair scorer: shared words over all words."""
    a, b = F.array_distinct(X.words(left)), F.array_distinct(X.words(right))
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)), F.lit(0.0))


def rerank_topk(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column] | None,
    query_col: str,
    passage_col: str,
    settings: RetrievalSettings = RetrievalSettings(),
) -> DataFrame:
    """Order candidates by an external pair score and keep the best few.

    Candidates below the floor go, unless all of a query's are below it.
    Without a scorer the fused order stands.
    """
    if scorer is None:
        return candidates.withColumn("rerank_score", F.col("rrf_score")).filter(
            F.col("rank") <= settings.context_k
        )
    scored = candidates.withColumn("rerank_score", scorer(F.col(query_col), F.col(passage_col)))
    per_query = W.partitionBy("q")  # at most fused_k rows
    passes = F.col("rerank_score") >= settings.rerank_floor
    kept = (
        scored.withColumn("_passes", passes)
        .withColumn("_any", F.max("_passes").over(per_query))
        .filter(F.col("_passes") | ~F.col("_any"))
    )
    w = W.partitionBy("q").orderBy(F.desc(F.round("rerank_score", _TIE)), "rank")
    return (
        kept.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= settings.context_k)
        .drop("rank", "_passes", "_any")
        .withColumnRenamed("_r", "rank")
    )


def mmr_select(
    candidates: DataFrame, vectors: DataFrame, k: int = 3, trade_off: float = 0.7
) -> DataFrame:
    """Greedy relevance-versus-diversity choice of k candidates per query.

    ``candidates``: ``(q, id, rel, rank)``, a short ranked list per query;
    ``vectors``: ``(id, vec)``.  Gives ``(q, id, pick)``.
    """
    item = F.struct("rank", "id", "rel", F.col("vec").cast("array<double>").alias("vec"))
    lists = (
        candidates.join(vectors.select("id", "vec"), "id")
        .groupBy("q")
        .agg(F.array_sort(F.collect_list(item)).alias("c"))
        .select("q", "c.id", "c.rel", "c.vec")
    )

    @F.pandas_udf("array<bigint>")
    def choose(ids: pd.Series, rels: pd.Series, vecs: pd.Series) -> pd.Series:
        return pd.Series([_greedy(i, r, v, k, trade_off) for i, r, v in zip(ids, rels, vecs)], dtype=object)

    picked = lists.select("q", F.posexplode(choose("id", "rel", "vec")).alias("pick", "id"))
    return picked.select("q", "id", (F.col("pick") + 1).cast("bigint").alias("pick"))


def _greedy(ids, rel, vectors, k: int, trade_off: float) -> np.ndarray:
    """Ids in the order picked; the first candidate starts, the lowest position wins ties."""
    if len(ids) <= k:
        return ids
    vec = np.stack(vectors)
    order, nearest = [0], vec @ vec[0]
    while len(order) < k:
        gain = np.round(trade_off * rel - (1.0 - trade_off) * nearest, 12)
        gain[order] = -np.inf
        order.append(int(gain.argmax()))
        nearest = np.maximum(nearest, vec @ vec[order[-1]])
    return ids[order]


def cache_lookup(
    tickets: DataFrame,
    cache: DataFrame,
    settings: CacheSettings = CacheSettings(),
    pairing: str = "all",
) -> DataFrame:
    """Nearest cached entry of each ticket, where it is similar enough.

    ``tickets``: ``(q, vec)``; ``cache``: ``(id, vec, intent, draft_reply)``.
    """
    near = dense_topk(
        tickets, cache.select("id", "vec"), 1, settings.similarity_threshold, pairing
    )
    return near.join(cache.drop("vec"), "id").select(
        "q",
        F.col("id").alias("cache_id"),
        F.col("score").alias("similarity"),
        *cache_hit_columns("intent", "draft_reply"),
    )


def cache_hit_columns(intent: str, reply: str) -> list[Column]:
    """The fixed part of a cached answer."""
    return [
        F.col(intent).alias("predicted_intent"),
        F.lit(1.0).alias("classification_confidence"),
        F.lit("semantic_cache_hit").alias("classification_method"),
        F.col(reply).alias("draft_reply"),
        F.lit(False).alias("should_escalate"),
        F.lit("Resolved via semantic FAQ cache.").alias("escalation_reason"),
        F.lit("LOW").alias("risk_level"),
        F.lit(True).alias("cached"),
    ]


def cache_miss(tickets: DataFrame, hits: DataFrame, key: str = "q") -> DataFrame:
    return tickets.join(hits.select(key), key, "left_anti")


def cache_admission(
    scored: DataFrame,
    order: str,
    settings: CacheSettings = CacheSettings(),
    already: int = 0,
) -> DataFrame:
    """Answers worth caching; with a capacity, the first in arrival order that still fit.

    ``already`` is the number of entries the cache holds.
    """
    worth = scored.filter(
        ~F.col("should_escalate")
        & ~F.col("cached")
        & (F.col("classification_confidence") >= settings.min_confidence)
    )
    if settings.max_entries is None:
        return worth
    return worth.orderBy(order).limit(max(0, settings.max_entries - already))
