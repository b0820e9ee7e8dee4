"""Language scores and sentiment as token joins against small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.functions import text as X
from ticketloom.operators.lexical import SENT_TERMS, text_parts
from ticketloom.session import attach


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return X.each(df, X.words(text_col), "token", id_col)


def learn_profile(labelled: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, token, weight)``: the share of each token in its language.  Counts combine map-side."""
    counts = (
        X.each(labelled, X.words(text), "token", F.col(lang).alias("lang"))
        .groupBy("lang", "token")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select(
        "lang", "token", (F.col("n") / F.col("total")).alias("weight")
    )


def detect_language(df: DataFrame, id_col: str, text_col: str, profile: DataFrame) -> DataFrame:
    """``(id, detected, score)``: the language whose profile covers the text best.

    Texts that hit no profile are absent; callers keep them, as a detector
    failure does.
    """
    parts = text_parts(df.select(F.col(text_col).alias("text")))
    counts = token_counts(df.select(id_col, text_col).repartition(parts, id_col), id_col, text_col)
    counts = counts.groupBy(id_col, "token").agg(F.count("*").alias("n"))
    if profile.count() <= SENT_TERMS:  # goes to every task
        met = counts.join(F.broadcast(profile), "token")
    else:
        met = counts.repartition(parts, "token").join(profile, "token")
    scores = met.groupBy(id_col, "lang").agg(F.round(F.sum(F.col("weight") * F.col("n")), 9).alias("score"))
    # max over (score, reversed order of lang): ties go to the first name
    w = W.partitionBy(id_col).orderBy(F.desc("score"), "lang")
    return (
        scores.withColumn("i", F.row_number().over(w))
        .filter(F.col("i") == 1)
        .select(id_col, F.col("lang").alias("detected"), "score")
    )


def language_filter(
    df: DataFrame, id_col: str, text_col: str, profile: DataFrame, keep: str = "en"
) -> DataFrame:
    """Add ``is_kept``: script test first, then the profile; no evidence keeps the text."""
    detected = detect_language(df, id_col, text_col, profile)
    short = F.length(X.strip(text_col)) < 5
    by_profile = F.coalesce(F.col("detected") == keep, F.lit(True))
    return df.join(detected, id_col, "left").withColumn(
        "is_kept", X.is_western_script(text_col) & (short | by_profile)
    )


def with_sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Add ``sentiment``, ``s / sqrt(s*s + 15)`` with s the sum over the text's lexicon words; 0 without one.

    The lexicon comes to the rows as one map, so texts stay where they are.
    """
    whole = lexicon.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("valence").alias("v"))
    entries = whole.agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("_lexicon"))
    rows = attach(df.withColumn("_words", X.words(text_col)), entries)
    total = F.aggregate(
        F.array_intersect("_words", F.map_keys("_lexicon")),
        F.lit(0.0),
        lambda s, w: s + F.col("_lexicon")[w] * F.size(F.filter("_words", lambda x: x == w)),
    )
    scored = rows.withColumn("_s", F.coalesce(total, F.lit(0.0)))
    return scored.withColumn("sentiment", F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15)).drop(
        "_words", "_lexicon", "_s"
    )


def sentiment_scores(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, sentiment)`` of every text."""
    return with_sentiment(df.select(id_col, text_col), id_col, text_col, lexicon).select(id_col, "sentiment")
