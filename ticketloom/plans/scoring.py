"""The composed jobs: ticket scoring, golden set, baselines.

Each is one DataFrame plan over all tickets of all brands.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.config import (
    BASELINE_KEYWORDS,
    BASELINE_REPLY,
    OFFLINE_DRAFT,
    RISK_KEYWORDS,
    RULE_CONFIDENCE,
    TRIVIAL_REPLY,
    CacheSettings,
    EscalationSettings,
    RetrievalSettings,
)
from ticketloom.functions import text as X
from ticketloom.operators import lexical
from ticketloom.operators.hybrid import (
    attach_passages,
    cache_hit_columns,
    cache_miss,
    rerank_topk,
    rrf_fuse,
    token_jaccard,
)
from ticketloom.operators.intents import validate_intent, with_eligibility
from ticketloom.operators.language import with_sentiment
from ticketloom.operators.policy import escalation_policy, golden_label, top_similarity
from ticketloom.operators.sampling import seeded_sample
from ticketloom.session import materialize

SCORED_COLUMNS = (
    "ticket_id", "brand", "query", "predicted_intent", "classification_confidence",
    "classification_method", "draft_reply", "retrieved_context", "should_escalate",
    "escalation_reason", "risk_level", "cached",
)


def index_corpus(
    corpus: DataFrame, settings: RetrievalSettings = RetrievalSettings(), params: lexical.TfIdf = lexical.TfIdf()
) -> lexical.TextIndex:
    """The index that :func:`retrieve` searches; build or load it once for all tickets to come."""
    passages = lexical.as_collection(corpus, "passage_id", "customer_query", "brand")
    return lexical.build_index(passages, settings.candidate_pool, tfidf=params)


def retrieve(
    tickets: DataFrame,
    index: lexical.TextIndex,
    settings: RetrievalSettings = RetrievalSettings(),
) -> DataFrame:
    """Fused candidates per ticket, within its brand: dense by tf-idf cosine, sparse by BM25.

    ``(q, doc, similarity_score, lexical_score, rrf_score, rank)``.
    """
    queries = lexical.as_collection(tickets, "ticket_id", "query", "brand")
    dense = lexical.cosine_search(queries, index, settings.candidate_pool)
    sparse = lexical.bm25_search(queries, index, settings.candidate_pool)
    return rrf_fuse(dense, sparse, settings)


def retrieve_contexts(
    tickets: DataFrame,
    corpus: DataFrame,
    settings: RetrievalSettings = RetrievalSettings(),
    scorer: Callable[[Column, Column], Column] | None = token_jaccard,
    index: lexical.TextIndex | None = None,
) -> DataFrame:
    """The re-ranked contexts of each ticket, one row per context; without an index one is built."""
    candidates = attach_passages(retrieve(tickets, index or index_corpus(corpus, settings), settings), corpus)
    asked = tickets.select(F.col("ticket_id").alias("q"), X.normalize_text("query").alias("_asked"))
    return rerank_topk(
        candidates.join(asked, "q"), scorer, "_asked", "historical_resolution", settings
    ).drop("_asked")


def nest_contexts(contexts: DataFrame) -> DataFrame:
    """``(ticket_id, retrieved_context, top_similarity)``: at most ``context_k`` items each."""
    item = F.struct(
        F.col("doc").alias("passage_id"), "customer_query", "historical_resolution", "intent",
        "similarity_score", "lexical_score", "rerank_score",
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return contexts.groupBy(F.col("q").alias("ticket_id")).agg(
        F.transform(ordered, lambda x: x["item"]).alias("retrieved_context"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity_score"))).alias("first_similarity"),
    )


def text_cache_hits(
    tickets: DataFrame, cache: DataFrame, settings: CacheSettings = CacheSettings()
) -> DataFrame:
    """Tickets whose nearest cached query, by tf-idf cosine within the brand, is close enough.

    ``cache``: ``(cache_id, brand, query, intent, draft_reply)``.
    """
    queries = lexical.as_collection(tickets, "ticket_id", "query", "brand")
    cached = lexical.as_collection(cache, "cache_id", "query", "brand")
    near = lexical.cosine_topk(queries, cached, 1).filter(
        F.col("score") >= settings.similarity_threshold
    )
    found = near.select(F.col("q").alias("ticket_id"), F.col("doc").alias("cache_id"))
    return found.join(cache.select("cache_id", "intent", F.col("draft_reply").alias("_reply")), "cache_id").select(
        "ticket_id", *cache_hit_columns("intent", "_reply")
    )


def score_tickets(
    tickets: DataFrame,
    corpus: DataFrame,
    intents: DataFrame,
    lexicon: DataFrame,
    classify: Callable[[Column], Column],
    cache: DataFrame | None = None,
    keywords: Sequence[str] = RISK_KEYWORDS,
    policy: EscalationSettings = EscalationSettings(),
    retrieval: RetrievalSettings = RetrievalSettings(),
    scorer: Callable[[Column, Column], Column] | None = token_jaccard,
    draft: Callable[[], Column] = lambda: F.lit(OFFLINE_DRAFT),
    index: lexical.TextIndex | None = None,
) -> DataFrame:
    """Score every ticket: cache, intent, retrieval, re-ranking, draft, escalation.

    ``tickets``: ``(ticket_id, brand, query, turn_count)``.  A ticket without
    contexts, sentiment or a known intent still gets a row: those parts are left
    joins with the documented defaults.
    """
    open_tickets = tickets
    hits = None
    if cache is not None:
        hits = materialize(text_cache_hits(tickets, cache), "cache-hits")  # five steps below read them
        open_tickets = cache_miss(tickets, hits, "ticket_id")

    contexts = nest_contexts(retrieve_contexts(open_tickets, corpus, retrieval, scorer, index))
    classified = open_tickets.withColumn("_raw", classify(X.normalize_text("query")))
    valid = validate_intent(classified, intents, "_raw").drop("_raw")
    ready = (
        with_eligibility(
            valid.withColumnRenamed("valid_intent", "predicted_intent"), intents, "predicted_intent"
        )
        .join(contexts, "ticket_id", "left")
        .withColumn("rag_similarity", top_similarity("first_similarity"))
        .withColumn("retrieved_context", F.coalesce("retrieved_context", F.array()))
        .withColumn("confidence", F.lit(RULE_CONFIDENCE))
    )
    decided = escalation_policy(
        with_sentiment(ready, "ticket_id", "query", lexicon), policy, keywords
    )
    scored = decided.withColumns(
        {
            "classification_confidence": F.col("confidence"),
            "classification_method": F.lit("track_a_few_shot_llm"),
            "draft_reply": draft(),
            "cached": F.lit(False),
        }
    ).select(*SCORED_COLUMNS)
    if hits is None:
        return scored
    answered = tickets.join(hits, "ticket_id").withColumn(
        "retrieved_context", F.array().cast(scored.schema["retrieved_context"].dataType)
    )
    return scored.unionByName(answered.select(*SCORED_COLUMNS))


def curate_golden(
    openings: DataFrame,
    brand: str,
    intents: DataFrame,
    lexicon: DataFrame,
    classify: Callable[[Column], Column],
    sample_size: int = 200,
    keywords: Sequence[str] | None = None,
) -> DataFrame:
    """The golden rows of one brand; ``golden_of`` and ``prelabels_of`` project the two tables.

    The example number follows the sampling order, over the sampled rows only.
    """
    from pyspark.sql import Window as W

    sampled = seeded_sample(openings, "thread_id", sample_size)
    number = F.row_number().over(W.orderBy(X.stable_order("thread_id"), "thread_id"))
    numbered = sampled.withColumn("brand", F.lit(brand)).withColumn(
        "example_id", F.concat(F.lit(f"{brand.lower()}_gold_"), F.lpad(number.cast("string"), 4, "0"))
    ).withColumn("llm_predicted_intent", classify(F.col("customer_query")))
    valid = validate_intent(numbered, intents, "llm_predicted_intent")
    ready = with_sentiment(
        with_eligibility(
            valid.withColumnRenamed("valid_intent", "ground_truth_intent"), intents, "ground_truth_intent"
        ),
        "thread_id",
        "customer_query",
        lexicon,
    )
    return golden_label(ready, "customer_query", **({"keywords": keywords} if keywords else {}))


def golden_of(curated: DataFrame) -> DataFrame:
    return curated.select(
        "example_id", "brand", "customer_query", "ground_truth_intent", "ground_truth_escalate",
        "escalation_rationale", F.lit(True).alias("verified_by_human"),
        F.col("sentiment").alias("sentiment_score"),
        F.lit("Verified via LLM pre-label + deterministic rule audit").alias("notes"),
    )


def prelabels_of(curated: DataFrame) -> DataFrame:
    return curated.select(
        "example_id", "brand", "customer_query", "llm_predicted_intent",
        F.lit(RULE_CONFIDENCE).alias("llm_confidence"),
        F.lit("Keyword matched customer intent.").alias("llm_reasoning"),
        F.col("ground_truth_escalate").alias("rule_escalate"),
        F.col("sentiment").alias("sentiment_score"),
    )


# ------------------------------------------------------------ baselines


def baseline_trivial(tickets: DataFrame, majority_intent: Column | str = "order_tracking_delivery") -> DataFrame:
    intent = F.lit(majority_intent) if isinstance(majority_intent, str) else majority_intent
    return tickets.select(
        "ticket_id",
        intent.alias("predicted_intent"),
        F.lit(1.0).alias("classification_confidence"),
        F.lit("trivial_majority_class").alias("classification_method"),
        F.lit(TRIVIAL_REPLY).alias("draft_reply"),
        F.lit(False).alias("should_escalate"),
        F.lit("Trivial baseline policy: never escalate.").alias("escalation_reason"),
        F.lit("LOW").alias("risk_level"),
    )


def draft_from_top1(tickets: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(ticket_id, draft_reply, lexical_score)``: the best BM25 passage's resolution."""
    queries = lexical.as_collection(tickets, "ticket_id", "query", "brand")
    passages = lexical.as_collection(corpus, "passage_id", "customer_query", "brand")
    best = lexical.bm25_topk(queries, passages, 1).select(
        F.col("q").alias("ticket_id"), F.col("doc").alias("passage_id"), F.col("score").alias("lexical_score")
    )
    replies = best.join(corpus.select("passage_id", "historical_resolution"), "passage_id")
    return tickets.select("ticket_id").join(replies, "ticket_id", "left").select(
        "ticket_id",
        F.coalesce("historical_resolution", F.lit(BASELINE_REPLY)).alias("draft_reply"),
        F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"),
    )


def baseline_escalation(
    df: DataFrame, query: str, keywords: Sequence[str] = BASELINE_KEYWORDS, sentiment_max: float = -0.50
) -> DataFrame:
    """Add ``should_escalate, escalation_reason, risk_level``; needs ``sentiment``."""
    risky = X.keyword_any(X.normalize_text(query), keywords)
    angry = F.col("sentiment") < sentiment_max
    reason = (
        F.when(risky, F.lit("Simple ML baseline trigger: Critical keyword detected."))
        .when(angry, F.format_string("Simple ML baseline trigger: Negative sentiment (%.2f).", F.col("sentiment")))
        .otherwise(F.lit("Simple ML baseline: Standard query, auto-handled."))
    )
    return (
        df.withColumn("should_escalate", risky | angry)
        .withColumn("escalation_reason", reason)
        .withColumn("risk_level", F.when(F.col("should_escalate"), "HIGH").otherwise("LOW"))
    )


_LEAST_FIT_PARTS = 8  # of training rows, where few cores are registered yet


def text_logreg(train: DataFrame, apply_to: DataFrame, text: str, label: str) -> DataFrame:
    """tf-idf and multinomial logistic regression; adds ``predicted_intent, classification_confidence``.

    The vocabulary and idf (at most 5,000 numbers) are the only model parts on
    the driver.  Every step of the fit shuffles one gradient (5,000 numbers a class) per partition, and a persisted
    table keeps all partitions it was made with, so the weighed rows are put into one partition per core.
    """
    params = lexical.TfIdf(max_features=5000, ngrams=2)

    def terms(df: DataFrame) -> DataFrame:
        return lexical.with_terms(df.withColumn("text", F.lower(X.normalize_text(text))), params).drop("text")

    fit_rows = terms(train).persist()
    try:
        counter = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=params.max_features).fit(fit_rows)
        counted = counter.transform(fit_rows)
        idf = IDF(inputCol="tf", outputCol="_idf").fit(counted).idf
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense([v + 1.0 for v in idf]), inputCol="tf", outputCol="raw"
        )
        unit = Normalizer(inputCol="raw", outputCol="features", p=2.0)
        index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(fit_rows)
        cores = max(_LEAST_FIT_PARTS, train.sparkSession.sparkContext.defaultParallelism)
        model = LogisticRegression(
            labelCol="_y", family="multinomial", regParam=1.0 / max(1, fit_rows.count()),
            standardization=False, maxIter=1000,
        ).fit(index.transform(unit.transform(weigh.transform(counted))).coalesce(cores))
    finally:
        fit_rows.unpersist()
    names = F.array(*[F.lit(n) for n in index.labels])
    out = model.transform(unit.transform(weigh.transform(counter.transform(terms(apply_to)))))
    return (
        out.withColumn("predicted_intent", F.get(names, F.col("prediction").cast("int")))
        .withColumn("classification_confidence", F.array_max(vector_to_array("probability")))
        .drop("terms", "tf", "raw", "features", "rawPrediction", "probability", "prediction")
    )
