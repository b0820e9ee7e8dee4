"""Escalation decisions and golden-set labelling as column chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.config import GOLDEN_KEYWORDS, RISK_KEYWORDS, EscalationSettings
from ticketloom.functions import text as X
from ticketloom.functions.probability import prediction_set

# One row per tier in evaluation order: (tier, escalates, risk).
TIERS = (
    ("intent_policy", True, "HIGH"),
    ("risk_keyword", True, "CRITICAL"),
    ("sentiment", True, "HIGH"),
    ("turns", True, "MEDIUM"),
    ("confidence", True, "MEDIUM"),
    ("grounding", True, "LOW"),
    ("auto", False, "LOW"),
)

# Message formats.
_REASONS = {
    "intent_policy": "Security Policy: Intent '%s' is classified as human-only handling.",
    "risk_keyword": "Risk Trigger: Critical keyword '%s' detected in customer message.",
    "sentiment": "Sentiment Trigger: High customer frustration detected (Sentiment Score: %.2f).",
    "turns": "Frustration Trigger: Customer has engaged in %d turns without resolution.",
    "confidence": "Model Uncertainty: Classifier confidence (%.2f) below threshold (%.2f).",
    "grounding": "Grounding Uncertainty: No sufficiently similar historical resolutions found in database.",
    "auto": "Standard customer inquiry with high classification confidence and grounding.",
}


def escalation_policy(
    df: DataFrame,
    settings: EscalationSettings = EscalationSettings(),
    keywords: Sequence[str] = RISK_KEYWORDS,
    query: str = "query",
) -> DataFrame:
    """Add ``tier, should_escalate, risk_level, escalation_reason``; the first tier that fits wins.

    Needs ``eligible, intent_name, sentiment, turn_count, confidence,
    rag_similarity`` and the query text.
    """
    keyword = F.col("_keyword")
    tier = (
        F.when(~F.col("eligible"), "intent_policy")
        .when(keyword.isNotNull(), "risk_keyword")
        .when(F.col("sentiment") < settings.sentiment_negative_max, "sentiment")
        .when(F.col("turn_count") >= settings.max_customer_turns, "turns")
        .when(F.col("confidence") < settings.confidence_min, "confidence")
        .when(F.col("rag_similarity") < settings.rag_similarity_min, "grounding")
        .otherwise("auto")
    )
    reason = (
        F.when(F.col("tier") == "intent_policy", F.format_string(_REASONS["intent_policy"], F.col("intent_name")))
        .when(F.col("tier") == "risk_keyword", F.format_string(_REASONS["risk_keyword"], keyword))
        .when(F.col("tier") == "sentiment", F.format_string(_REASONS["sentiment"], F.col("sentiment")))
        .when(F.col("tier") == "turns", F.format_string(_REASONS["turns"], F.col("turn_count")))
        .when(
            F.col("tier") == "confidence",
            F.format_string(_REASONS["confidence"], F.col("confidence"), F.lit(float(settings.confidence_min))),
        )
        .when(F.col("tier") == "grounding", F.lit(_REASONS["grounding"]))
        .otherwise(F.lit(_REASONS["auto"]))
    )
    risk = F.coalesce(*[F.when(F.col("tier") == t, F.lit(r)) for t, _, r in TIERS])
    normalised = X.normalize_text(query, full_entities=True)
    return (
        df.withColumn("_keyword", X.keyword_first(normalised, keywords))
        .withColumn("tier", tier)
        .withColumn("should_escalate", F.col("tier") != "auto")
        .withColumn("risk_level", risk)
        .withColumn("escalation_reason", reason)
        .drop("_keyword")
    )


def tier_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("tier", "risk_level").agg(F.count("*").alias("n"))


def tier_rollup(decided: DataFrame) -> DataFrame:
    """``(level, brand, tier, n, n_escalated)`` by brand and tier, by brand, and in total.

    ``level`` tells a row of all brands from the row of a null one.
    """
    level = F.when(F.grouping("brand") == 1, "total").when(F.grouping("tier") == 1, "brand").otherwise("tier")
    return decided.rollup("brand", "tier").agg(
        level.alias("level"), F.count("*").alias("n"), F.count_if("should_escalate").alias("n_escalated")
    )


def conformal_gate(df: DataFrame, probs: str, q_hat: Column | float) -> DataFrame:
    """Add ``prediction_set, set_size, auto_handle``: automatic only for exactly one member."""
    return (
        df.withColumn("prediction_set", prediction_set(probs, q_hat))
        .withColumn("set_size", F.size("prediction_set").cast("bigint"))
        .withColumn("auto_handle", F.col("set_size") == 1)
    )


def golden_label(
    df: DataFrame,
    query: str,
    keywords: Sequence[str] = GOLDEN_KEYWORDS,
    sentiment_max: float = -0.45,
) -> DataFrame:
    """Add ``ground_truth_escalate, escalation_rationale``.

    Needs ``eligible, sentiment, ground_truth_intent``.
    """
    risky = X.keyword_any(query, keywords)
    furious = F.col("sentiment") < sentiment_max
    rationale = (
        F.when(
            ~F.col("eligible"),
            F.format_string(
                "Intent '%s' requires human agent intervention per security policy.",
                F.col("ground_truth_intent"),
            ),
        )
        .when(risky, F.lit("Customer query contains high-risk legal/security escalation triggers."))
        .when(
            furious,
            F.format_string("Severe customer dissatisfaction detected (Sentiment: %.2f).", F.col("sentiment")),
        )
        .otherwise(F.lit("Standard customer issue eligible for automated resolution."))
    )
    return df.withColumn("ground_truth_escalate", ~F.col("eligible") | risky | furious).withColumn(
        "escalation_rationale", rationale
    )


def top_similarity(first_similarity: Column | str, default: float = 0.50) -> Column:
    """Similarity of the first context; the default where there is none."""
    c = F.col(first_similarity) if isinstance(first_similarity, str) else first_similarity
    return F.coalesce(c, F.lit(default))
