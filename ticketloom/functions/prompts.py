"""Prompt tables: one rendered text per row, ready for any batch inference job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.config import STATIC_EXEMPLARS, Brand
from ticketloom.functions import text as X


def intent_lines(brand: Brand, keywords: int = 5) -> str:
    lines = []
    for i in brand.intents:
        hint = f" (Keywords: {', '.join(i.keywords[:keywords])})" if keywords else ""
        lines.append(f"- {i.id}: {i.name} - {i.description}{hint}")
    return "\n".join(lines)


def exemplar_lines(exemplars: Sequence[tuple[str, str]] = STATIC_EXEMPLARS) -> str:
    return "\n".join(f'Query: "{q}" -> {intent}' for q, intent in exemplars)


def classifier_prompt(brand: Brand, query: Column | str, exemplars: Column | None = None) -> Column:
    """System and user part of the intent classifier, with static or per-row exemplars."""
    shown = F.lit(exemplar_lines()) if exemplars is None else exemplars
    return F.concat(
        F.lit(
            f"Classify messages for {brand.display_name}. Choose one intent id:\n"
            f"{intent_lines(brand)}\n\nExamples:\n"
        ),
        shown,
        F.lit('\n\nAnswer with an intent id, a confidence from 0 to 1 and, if unsure, other candidates.\nMessage: "'),
        X.normalize_text(query),
        F.lit('"'),
    )


def annotator_prompt(brand: Brand, query: Column | str) -> Column:
    query = F.col(query) if isinstance(query, str) else query
    return F.concat(
        F.lit(
            f"Annotate messages for {brand.display_name}. Choose one intent id:\n"
            f"{intent_lines(brand, 0)}\nState whether a person must handle it.\nMessage: \""
        ),
        query,
        F.lit('"'),
    )


def context_block(passage_id: str, query: str, resolution: str) -> Column:
    return F.concat(
        F.lit("["), F.col(passage_id), F.lit('] asked: "'), F.col(query),
        F.lit('" answered: "'), F.col(resolution), F.lit('"'),
    )


def context_text(contexts: DataFrame, key: str, rank: str, empty: str) -> DataFrame:
    """``(key, context_text)``; contexts are the few top-ranked passages of a ticket."""
    block = context_block("passage_id", "customer_query", "historical_resolution")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return contexts.groupBy(key).agg(
        F.coalesce(
            F.nullif(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n"), F.lit("")), F.lit(empty)
        ).alias("context_text")
    )


# What stands in for missing contexts.
NO_CONTEXT = "No historical context found."
NO_SOURCES = "No sources provided."


def draft_prompt(brand: Brand, query: str, intent: str, context: str) -> Column:
    p = brand.persona
    return F.concat(
        F.lit(
            f"Write a support reply for {brand.display_name}. Tone: {p.tone}. Greeting: {p.greeting} "
            f"Sign-off: {p.signoff} Link: {p.dm_action_url}\n"
            "Use only the sources, promise nothing, name a next step, stay within 280 characters.\n"
            'Message: "'
        ),
        X.normalize_text(query),
        F.lit('"\nIntent: '),
        F.col(intent),
        F.lit("\nSources:\n"),
        F.coalesce(F.col(context), F.lit(NO_CONTEXT)),
    )


def judge_prompt(brand_name: str, query: str, reply: str, context: str) -> Column:
    return F.concat(
        F.lit(
            f"Rate a support reply of @{brand_name} from 1 to 5 on grounding, tone, actionability, "
            'safety and overall quality.\nMessage: "'
        ),
        F.col(query),
        F.lit('"\nSources:\n'),
        F.coalesce(F.col(context), F.lit(NO_SOURCES)),
        F.lit('\nReply: "'),
        F.col(reply),
        F.lit('"'),
    )


def draft_checks(df: DataFrame, reply: str, action_url: Column | str) -> DataFrame:
    """The drafting rules as measurable predicates."""
    url = F.lit(action_url) if isinstance(action_url, str) else action_url
    promise = r"(?i)\b(i|we)('ve| have)? (refunded|credited|reimbursed|guarantee)|\bwill arrive (on|by)\b"
    return (
        df.withColumn("fits_length", F.length(reply) <= 280)
        .withColumn("has_action_link", F.contains(F.col(reply), url))
        .withColumn("has_promise", F.col(reply).rlike(promise))
    )
