"""Intent assignment: ordered rules, keyword scores, calibrated classes, k-NN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ticketloom.config import DEFAULT_INTENT, INTENT_RULES, RULE_CONFIDENCE, Brand
from ticketloom.functions import text as X
from ticketloom.operators.dense import dense_topk
from ticketloom.session import literal_table


def intent_dim(spark: SparkSession, brands: Sequence[Brand]) -> DataFrame:
    """One row per brand and intent."""
    rows = [
        (b.id, b.name, i, x.id, x.name, x.description, list(x.keywords), x.auto_handle_eligible)
        for b in brands
        for i, x in enumerate(b.intents)
    ]
    return literal_table(
        spark,
        rows,
        "brand string, brand_name string, ord int, intent_id string, name string, "
        "description string, keywords array<string>, auto_handle_eligible boolean",
    )


def rule_intent(
    text: Column | str,
    rules: Sequence[tuple[str, Sequence[str]]] = INTENT_RULES,
    default: str = DEFAULT_INTENT,
) -> Column:
    """Offline classifier: the first rule group with a substring hit."""
    hits = [F.when(X.keyword_any(text, keys), F.lit(intent)) for intent, keys in rules]
    return F.coalesce(*hits, F.lit(default))


def rule_confidence() -> Column:
    return F.lit(RULE_CONFIDENCE)


def validate_intent(df: DataFrame, dim: DataFrame, intent: str, brand: str = "brand") -> DataFrame:
    """Replace an intent outside its brand's taxonomy by the brand's first one (``valid_intent``)."""
    known = dim.select(F.col("brand").alias(brand), F.col("intent_id").alias(intent), F.lit(True).alias("_known"))
    first = dim.filter("ord = 0").select(F.col("brand").alias(brand), F.col("intent_id").alias("_first"))
    return (
        df.join(known, [brand, intent], "left")
        .join(first, brand, "left")
        .withColumn("valid_intent", F.when(F.col("_known"), F.col(intent)).otherwise(F.col("_first")))
        .drop("_known", "_first")
    )


def with_eligibility(df: DataFrame, dim: DataFrame, intent: str, brand: str = "brand") -> DataFrame:
    """Add ``eligible`` and ``intent_name``; an unknown intent may be auto-handled."""
    looked = dim.select(
        F.col("brand").alias(brand),
        F.col("intent_id").alias(intent),
        F.col("name").alias("intent_name"),
        F.col("auto_handle_eligible").alias("eligible"),
    )
    return df.join(looked, [brand, intent], "left").withColumn("eligible", F.coalesce("eligible", F.lit(True)))


def label_index(df: DataFrame, dim: DataFrame, label: str, brand: str = "brand") -> DataFrame:
    """Add ``label_id``, the label's place in its brand's taxonomy; an unknown label gets 0."""
    ids = dim.select(F.col("brand").alias(brand), F.col("intent_id").alias(label), F.col("ord").alias("label_id"))
    return df.join(ids, [brand, label], "left").withColumn(
        "label_id", F.coalesce("label_id", F.lit(0)).cast("bigint")
    )


def keyword_intent_score(
    df: DataFrame, id_col: str, text_col: str, taxonomy: Sequence[tuple[str, Sequence[str]]]
) -> DataFrame:
    """``(id, intent, hits)``: the intent with most keywords found, first in list order; null and 0 without any.

    One pass over the text, no join: the taxonomy is a fixed, short list.
    """
    counts = [
        F.struct(
            sum(
                (F.contains(F.col("_t"), F.lit(k)).cast("int") for k in keys), start=F.lit(0)
            ).alias("hits"),
            F.lit(-i).alias("neg_ord"),
            F.lit(intent).alias("intent"),
        )
        for i, (intent, keys) in enumerate(taxonomy)
    ]
    return (
        df.select(id_col, F.lower(text_col).alias("_t"))
        .select(id_col, F.array_max(F.array(*counts)).alias("best"))
        .select(
            id_col,
            F.when(F.col("best.hits") > 0, F.col("best.intent")).alias("intent"),
            F.coalesce("best.hits", F.lit(0)).cast("bigint").alias("hits"),
        )
    )


def knn_exemplars(
    queries: DataFrame, pool: DataFrame, k: int = 3, pairing: str = "others"
) -> DataFrame:
    """``(q, rank, exemplar_id, intent, score)``: nearest labelled examples per query.

    ``pool``: ``(id, vec, intent)``.
    """
    near = dense_topk(queries, pool.select("id", "vec"), k, None, pairing)
    return near.join(pool.select("id", "intent"), "id").select(
        "q", "rank", F.col("id").alias("exemplar_id"), "intent", "score"
    )


def vote(exemplars: DataFrame) -> DataFrame:
    """``(q, intent)``: majority intent of the exemplars; ties go to the nearest."""
    votes = exemplars.groupBy("q", "intent").agg(
        F.count("*").alias("n"), F.min("rank").alias("best")
    )
    w = W.partitionBy("q").orderBy(F.desc("n"), "best")
    return votes.withColumn("i", F.row_number().over(w)).filter(F.col("i") == 1).select("q", "intent")


def fit_logreg(train: DataFrame, vec: str, label: str, c: float = 1.0, weight: str | None = None):
    """Multinomial logistic regression with an L2 strength of ``1 / (c * n)``."""
    n = train.count()
    model = LogisticRegression(
        featuresCol="_f",
        labelCol=label,
        regParam=1.0 / (c * max(1, n)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        family="multinomial",
        **({"weightCol": weight} if weight else {}),
    )
    return model.fit(train.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>"))))


def apply_logreg(model, df: DataFrame, vec: str) -> DataFrame:
    """Add ``predicted`` and ``confidence``."""
    out = model.transform(df.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>"))))
    return (
        out.withColumn("confidence", F.array_max(vector_to_array("probability")))
        .withColumn("predicted", F.col("prediction").cast("bigint"))
        .drop("_f", "rawPrediction", "probability", "prediction")
    )


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, first name on ties."""
    return (
        df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)
