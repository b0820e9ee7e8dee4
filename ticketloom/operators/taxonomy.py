"""Discovery of intent groups by clustering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.operators.lexical import TfIdf, tfidf_vectors, tfidf_vocabulary
from ticketloom.session import materialize

KEYWORD_TERMS = TfIdf(max_features=5000, min_df=3, ngrams=2)
CLUSTER_TERMS = TfIdf(max_features=1000, min_df=1, ngrams=1)


def kmeans_labels(df: DataFrame, id_col: str, vec: str, k: int = 7, seed: int = 42, starts: int = 10) -> DataFrame:
    """``(id, cluster)`` from the best of several k-means starts."""
    points = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("features")).persist()
    try:
        models = (KMeans(k=k, seed=seed + i, featuresCol="features").fit(points) for i in range(starts))
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        points.unpersist()
    assigned = best.transform(
        df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    )
    return assigned.select(id_col, F.col("prediction").alias("cluster"))


@dataclass
class TextClusters:
    """``labels``: ``(id, cluster)``; ``centres``: ``(cluster, term, weight)``; ``costs``: ``(start, cost, chosen)``."""

    labels: DataFrame
    centres: DataFrame
    costs: DataFrame


def text_kmeans(
    df: DataFrame, id_col: str, text: str, k: int = 7, seed: int = 42, starts: int = 10, rounds: int = 30, params: TfIdf = CLUSTER_TERMS
) -> TextClusters:
    """Spherical k-means over the texts' tf-idf rows; the best of several starts, by the sum of 1 - cosine.

    All starts go through the rows together: a round is one pass, in which tasks multiply blocks of rows with the centres of
    all starts and add up the rows of each cluster.  Centres are ``starts * k`` rows of at most ``params.max_features``
    weights, whatever the input, so they travel with the tasks.  A start begins with the k texts whose seeded hashes are lowest.
    A cluster that loses all its rows keeps its centre.  Texts without a term of the vocabulary are in cluster 0;
    a null text is empty.  With fewer texts than k there are fewer clusters; without any term there is only cluster 0.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    texts = df.select(
        F.lit("").alias("grp"), F.col(id_col).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.lit(1).cast("bigint").alias("n_copies")
    )
    vocabulary = materialize(tfidf_vocabulary(texts, params), "vocabulary")
    terms = [r.term for r in vocabulary.select("term").orderBy("term").collect()]  # at most params.max_features
    if not terms:
        labels = df.select(F.col(id_col).alias("id"), F.lit(0).alias("cluster"))
        return TextClusters(
            labels, spark.createDataFrame([], "cluster int, term string, weight double"), spark.createDataFrame([], "start int, cost double, chosen boolean")
        )
    numbered = spark.createDataFrame(list(enumerate(terms)), "place int, term string")
    vectors = tfidf_vectors(texts, vocabulary, params).join(F.broadcast(numbered), "term")
    rows = vectors.groupBy("doc").agg(F.collect_list(F.struct("place", "w")).alias("v"))
    rows = materialize(rows.select("doc", F.col("v.place").alias("places"), F.col("v.w").alias("weights")), "tfidf-rows")
    firsts = []
    for s in range(starts):
        order = F.md5(F.concat(F.lit(f"{seed}:{s}:"), F.col("doc").cast("string")))
        firsts.append(rows.orderBy(order, "doc").limit(k).collect())
    k = len(firsts[0])
    centres = np.zeros((starts, k, len(terms)))
    for s, some in enumerate(firsts):
        for c, r in enumerate(some):
            centres[s, c, r.places] = r.weights

    def blocks(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                place, edges = part.column("places"), part.column("places").offsets.to_numpy()
                x = np.zeros((part.num_rows, len(terms)))
                x[np.repeat(np.arange(part.num_rows), np.diff(edges)), place.flatten().to_numpy()] = part.column("weights").flatten().to_numpy()
                yield part, x

    def one_pass(centres):
        flat = centres.reshape(starts * k, -1)

        def step(batches):
            sums, cost = np.zeros(centres.shape), np.zeros(starts)
            for _, x in blocks(batches):
                score = (x @ flat.T).reshape(len(x), starts, k)
                best = score.argmax(axis=2)
                cost += (1 - np.take_along_axis(score, best[..., None], 2)[..., 0]).sum(axis=0)
                for s in range(starts):
                    sums[s] += (best[:, s] == np.arange(k)[:, None]).astype(float) @ x
            data = [np.append(cost[s], sums[s]).tobytes() for s in range(starts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(starts), pa.int32()), pa.array(data, pa.binary())], ["start", "data"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for s, data in zip(b.column("start").to_pylist(), b.column("data").to_pylist()):
                    total[s] = total.get(s, 0) + np.frombuffer(data)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["start", "data"])

        schema = "start int, data binary"
        found = rows.mapInArrow(step, schema).repartition(starts, "start").mapInArrow(add, schema).collect()
        cost, sums = np.zeros(starts), np.zeros(centres.shape)
        for r in found:  # one row a start
            data = np.frombuffer(r.data)
            cost[r.start], sums[r.start] = data[0], data[1:].reshape(k, -1)
        length = np.linalg.norm(sums, axis=2, keepdims=True)
        return cost, np.where(length > 0, sums / np.maximum(length, 1e-300), centres)

    cost, moved = one_pass(centres)
    for _ in range(rounds):
        following, next_ = one_pass(moved)
        done = (following >= cost - 1e-9).all()
        centres, moved, cost = moved, next_, following
        if done:
            break
    chosen = int(cost.argmin())
    own = centres[chosen]

    def label(batches):
        for part, x in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array((x @ own.T).argmax(axis=1).astype(np.int32))], ["doc", "cluster"])

    placed = rows.mapInArrow(label, f"doc {kind.simpleString()}, cluster int")
    labels = df.select(F.col(id_col).alias("id")).join(placed.withColumnRenamed("doc", "id"), "id", "left").select(
        "id", F.coalesce("cluster", F.lit(0)).alias("cluster")
    )
    weights = [(int(c), terms[t], float(own[c, t])) for c, t in zip(*np.nonzero(own))]
    costs = [(s, float(x), s == chosen) for s, x in enumerate(cost)]
    return TextClusters(
        materialize(labels, "labels"), materialize(spark.createDataFrame(weights, "cluster int, term string, weight double"), "centres"),
        spark.createDataFrame(costs, "start int, cost double, chosen boolean"),
    )


def discovery(df: DataFrame, id_col: str, text: str, found: TextClusters) -> DataFrame:
    """``(cluster, size, percentage, top_keywords, exemplar_queries)`` of clustered texts."""
    labelled = df.join(found.labels.withColumnRenamed("id", id_col), id_col)
    words = cluster_keywords(labelled, "cluster", id_col, text)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    top = words.groupBy("cluster").agg(F.transform(ordered, lambda x: x["term"]).alias("top_keywords"))
    return cluster_summary(labelled, "cluster", id_col, text).join(top, "cluster", "left")


def cluster_summary(df: DataFrame, cluster: str, id_col: str, text: str, exemplars: int = 3) -> DataFrame:
    """``(cluster, size, percentage, exemplar_queries)``; exemplars in id order."""
    total = df.agg(F.count("*").alias("n")).scalar()
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size")).withColumn(
        "percentage", F.round(F.col("size") / total * 100, 2)
    )
    w = W.partitionBy(cluster).orderBy(id_col)
    first = (
        df.withColumn("_i", F.row_number().over(w))
        .filter(F.col("_i") <= exemplars)
        .groupBy(cluster)
        .agg(F.array_sort(F.collect_list(F.struct("_i", text))).alias("_e"))
        .select(cluster, F.transform("_e", lambda e: e[text]).alias("exemplar_queries"))
    )
    return sizes.join(first, cluster)


def cluster_keywords(
    df: DataFrame, cluster: str, id_col: str, text: str, top_n: int = 8, params: TfIdf = KEYWORD_TERMS
) -> DataFrame:
    """``(cluster, term, mean_tfidf, rank)``; cluster -1 is noise and left out.

    The mean counts texts without the term as 0.
    """
    kept = df.filter(F.col(cluster) != -1)
    texts = kept.select(
        F.lit("").alias("grp"),
        F.col(id_col).alias("doc"),
        F.lower(text).alias("text"),
        F.lit(1).cast("bigint").alias("n_copies"),
    )
    vocabulary = materialize(tfidf_vocabulary(texts, params), "vocabulary")
    vectors = tfidf_vectors(texts, vocabulary, params)
    sizes = kept.groupBy(cluster).agg(F.count("*").alias("_n"))
    labels = kept.select(F.col(id_col).alias("doc"), cluster)
    means = (
        vectors.join(labels, "doc")
        .groupBy(cluster, "term")
        .agg(F.sum("w").alias("_s"))
        .join(sizes, cluster)
        .select(cluster, "term", (F.col("_s") / F.col("_n")).alias("mean_tfidf"))
    )
    w = W.partitionBy(cluster).orderBy(F.desc(F.round("mean_tfidf", 9)), "term")
    return means.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
