"""The supplied Parquet tables and the message-shaped views derived from them."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.config import Intent
from ticketloom.functions.probability import argmax, softmax
from ticketloom.operators import language
from ticketloom.operators.threads import has_text
from ticketloom.session import attach, literal_table, materialize
from ticketloom.sources.files import spread

# A taxonomy, risk words and a sentiment lexicon whose words occur
# in the supplied documents.
BRANDS = ("Brand0", "Brand1", "Brand2")
TAXONOMY = (
    Intent("topic_thing", "Thing topics", "", ("thing", "oning")),
    Intent("topic_tion", "Tion topics", "", ("thtion", "attion", "ontion")),
    Intent("topic_ble", "Ble topics", "", ("thble", "erble")),
    Intent("topic_er", "Er topics", "", ("eriner", "ering")),
    Intent("topic_abuse", "Abuse and grievance", "", ("idiot", "trash", "scum", "moron"), False),
    Intent("topic_other", "Everything else", "", ()),
)
# Brands differ: one handles fewer intents by itself, one lacks the first.
TAXONOMIES = {
    "Brand0": TAXONOMY,
    "Brand1": tuple(replace(x, auto_handle_eligible=x.auto_handle_eligible and x.id != "topic_er") for x in TAXONOMY),
    "Brand2": TAXONOMY[1:],
}
RISK_WORDS = ("idiot", "trash", "scum", "worthless")
LEXICON = (
    ("idiot", -2.3), ("trash", -1.8), ("clown", -1.2), ("scum", -2.8), ("worthless", -1.9),
    ("pathetic", -2.1), ("moron", -2.5), ("loser", -2.0), ("disgusting", -2.4), ("stupid", -2.4),
    ("thing", 0.6), ("oning", 0.4),
)
BASE_TEMPERATURE = 0.02


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.read("documents"))

    @cached_property
    def conversations(self) -> DataFrame:
        return spread(self.read("conversations"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.read("benchmark")

    @cached_property
    def labels(self) -> DataFrame:
        return self.read("labels")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def tweets(self) -> DataFrame:
        """Conversations as messages with reply pointers.

        In every fourth conversation the later replies answer the first customer
        message, so that some messages have several replies.
        """
        c = self.conversations
        first_user = (
            c.filter(F.col("role") == "user")
            .groupBy(F.col("conv_id").alias("fc"))
            .agg(F.min("turn").alias("fu"))
        )
        joined = c.join(first_user, F.col("conv_id") == F.col("fc"))
        conv, turn = F.col("conv_id"), F.col("turn")
        is_user = F.col("role") == "user"
        redirected = (F.col("role") == "assistant") & (turn >= 3) & (conv % 4 == 0)
        return joined.select(
            (conv * 1000 + turn).cast("string").alias("tweet_id"),
            F.when(is_user, F.concat(F.lit("u"), (conv % 17).cast("string")))
            .otherwise(F.concat(F.lit("Brand"), (conv % 3).cast("string")))
            .alias("author_id"),
            is_user.alias("inbound"),
            F.concat(
                F.lit("2024-01-"),
                F.lpad((1 + conv % 28).cast("string"), 2, "0"),
                F.lit(" 00:"),
                F.lpad((turn * 5).cast("string"), 2, "0"),
                F.lit(":00"),
            ).alias("created_at"),
            "text",
            F.when(redirected, (conv * 1000 + F.col("fu")).cast("string"))
            .when(turn > 0, (conv * 1000 + turn - 1).cast("string"))
            .alias("in_response_to_tweet_id"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        """Language profiles learned from the labelled documents."""
        return materialize(language.learn_profile(self.documents, "lang", "text"), "profile")

    @cached_property
    def english_tweets(self) -> DataFrame:
        """``tweet_id`` of the customer messages that the language filter keeps."""
        asked = self.tweets.filter(F.col("inbound") & has_text("text")).select("tweet_id", "text")
        return language.language_filter(asked, "tweet_id", "text", self.profile).filter("is_kept").select("tweet_id").distinct()

    @cached_property
    def tickets(self) -> DataFrame:
        """Labelled documents with classifier-like columns, as input of the policy."""
        d = F.col("doc_id")
        intents = ("topic_thing", "topic_tion", "topic_ble", "topic_er", "topic_abuse", "topic_unknown")
        return self.documents.join(self.labels, "doc_id").select(
            d.alias("ticket_id"),
            F.col("text").alias("query"),
            F.concat(F.lit("Brand"), (d % 3).cast("string")).alias("brand"),
            F.get(F.array(*map(F.lit, intents)), (d % 6).cast("int")).alias("predicted_intent"),
            (0.5 + (d * 37 % 51) / 100).alias("confidence"),
            (1 + d * 7 % 4).alias("turn_count"),
            (0.4 + (d * 53 % 61) / 100).alias("rag_similarity"),
            ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("true_escalate"),
        )

    @cached_property
    def intents(self) -> DataFrame:
        rows = [(b, x.id, x.name, i, x.auto_handle_eligible) for b, own in TAXONOMIES.items() for i, x in enumerate(own)]
        return literal_table(
            self.spark, rows, "brand string, intent_id string, name string, ord int, auto_handle_eligible boolean"
        )

    @cached_property
    def lexicon(self) -> DataFrame:
        return literal_table(self.spark, list(LEXICON), "word string, valence double")

    @cached_property
    def probs(self) -> DataFrame:
        """``(vec_id, y, z, p)``: nearest-centroid logits and softmax as arrays per row.

        Written once, as a classifier's output table would be.
        Only the per-class centroids (classes x dimensions numbers) are shared
        with the rows; the rows themselves are not shuffled.
        """
        parts = self.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
        centroid = (
            parts.groupBy("label", "i")
            .agg(F.avg(F.col("v").cast("double")).alias("c"))
            .groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs"))
            .select("label", F.transform("cs", lambda s: s["c"]).alias("c"))
        )
        all_classes = centroid.agg(
            F.transform(F.array_sort(F.collect_list(F.struct("label", "c"))), lambda s: s["c"]).alias("m")
        )  # one row: classes x dimensions numbers

        def dot(a, b):
            products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
            return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

        logits = F.transform("m", lambda c: dot(F.col("embedding"), c))
        scored = attach(self.embeddings, all_classes).select(
            "vec_id", F.col("label").cast("bigint").alias("y"), logits.alias("z")
        )
        return materialize(scored.withColumn("p", softmax("z", BASE_TEMPERATURE)), "probs")

    @cached_property
    def predictions(self) -> DataFrame:
        """``(vec_id, y, pred, confidence, correct, p_true)``."""
        return self.probs.select(
            "vec_id",
            "y",
            argmax("p").alias("pred"),
            F.array_max("p").alias("confidence"),
            F.get("p", F.col("y").cast("int")).alias("p_true"),
        ).withColumn("correct", F.col("pred") == F.col("y"))

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

    @property
    def query_vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
