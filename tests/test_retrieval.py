import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.config import CacheSettings, RetrievalSettings
from ticketloom.operators import dense, hybrid, lexical, taxonomy
from ticketloom.session import materialize


def texts(n, seed, hot=0.0, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    out = []
    for i in range(n):
        if rng.random() < hot:
            out.append((i, "w0 w1 w2 the same text"))
        else:
            out.append((i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 15)))))
    return out


def collection(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    return lexical.as_collection(df, "id", "text")


def brute_bm25(queries, corpus, k):
    tokens = {i: t.split() for i, t in corpus}
    n, avgdl = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {}
    for ws in tokens.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in queries:
        scores = []
        for d, ws in tokens.items():
            s = sum(
                idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
                for w in text.split()
            )
            scores.append((-round(s, 9), d))
        out[q] = [(d, round(-s, 6)) for s, d in sorted(scores)[:k] if s < 0]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.doc, round(r.score, 6)))
    return out


@pytest.mark.parametrize("direct_rows", [0, 10**9])
def test_bm25_equals_brute_force_with_many_copies(spark, monkeypatch, direct_rows):
    monkeypatch.setattr(lexical.sparse_topk, "__defaults__", (direct_rows,))
    corpus, queries = texts(300, 1, hot=0.35), texts(25, 2)
    got = as_lists(lexical.bm25_topk(collection(spark, queries), collection(spark, corpus), 5))
    want = {q: v for q, v in brute_bm25(queries, corpus, 5).items() if v}
    assert got == want


@pytest.mark.parametrize("k", [1, 4])
def test_pruned_search_equals_direct_search(spark, k):
    rng = np.random.default_rng(3)
    posts = [(f"t{t}", d, float(w)) for t in range(40) for d, w in zip(rng.choice(200, 150 // (t + 1) + 1, False).tolist(), rng.random(200))]
    postings = spark.createDataFrame([("", *p) for p in posts], "grp string, term string, doc long, w double")
    stats = postings.groupBy("grp", "term").agg(F.count("*").alias("n_posts"), F.max("w").alias("max_w"))
    asked = [("", q, f"t{t}", float(rng.random() * (t + 1) - 0.3)) for q in range(12) for t in rng.choice(40, 8, False).tolist()]
    weighted = spark.createDataFrame(asked, "grp string, q long, term string, qw double").join(stats, ["grp", "term"])
    direct = lexical.sparse_topk(weighted, postings, k)
    pruned = lexical.sparse_topk(weighted, postings, k, direct_rows=0)
    assert as_lists(direct) == as_lists(pruned)


@pytest.mark.parametrize("sizes", [(40, 10**9, 64), (10**9, 50, 5), (10**9, 10**9, 1)])
def test_blocks_equal_one_join_and_give_k_rows_each(spark, monkeypatch, sizes):
    for name, size in zip(("_BLOCK_ROWS", "_TASK_WORK", "_TASKS"), sizes):
        monkeypatch.setattr(lexical, name, size)
    rng = np.random.default_rng(5)
    # two collections, strings as ids, a null id, a document with the same term twice, weights of 0 and below
    posts = [(g, f"t{t}", f"d{d}", float(rng.integers(0, 3))) for g in "ab" for t in range(30) for d in rng.choice(90, 60 // (t + 1) + 1, False).tolist()]
    posts += [("a", "t0", "d1", 1.0), ("a", "t1", None, 2.0)]
    postings = spark.createDataFrame(posts, "grp string, term string, doc string, w double")
    stats = postings.groupBy("grp", "term").agg(F.count("*").alias("n_posts"), F.max("w").alias("max_w"))
    asked = [(g, q, f"t{t}", float(rng.integers(-1, 4))) for g in "ab" for q in range(15) for t in rng.choice(35, 6, False).tolist()]
    weighted = spark.createDataFrame(asked, "grp string, q long, term string, qw double").join(stats, ["grp", "term"])
    direct = {tuple(r) for r in lexical.sparse_topk(weighted, postings, 3, direct_rows=10**9).select("grp", "q", "doc", "score", "rank").collect()}
    assert {tuple(r) for r in lexical.sparse_topk(weighted, postings, 3, direct_rows=0).select("grp", "q", "doc", "score", "rank").collect()} == direct
    found = lexical._block_scores(weighted.select("grp", "q", "term", "qw", "n_posts"), postings, 3)
    assert found.groupBy("grp", "q", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3 * 64
    pairs = weighted.join(postings, ["grp", "term"]).select("grp", "q", "doc").distinct().count()
    assert sizes[2] > 1 or found.count() <= 30 * 3 < pairs


def test_terms_are_counted_in_partitions_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_PART_BYTES", 100)
    reps = collection(spark, texts(300, 7)).withColumn("n_copies", F.lit(1).cast("bigint"))
    size = sum(len(r.text) for r in reps.collect())
    assert lexical.text_parts(reps) == size // 100 + 1 > 50
    assert lexical.bm25_counts(reps).rdd.getNumPartitions() == size // 100 + 1
    vocabulary = lexical.tfidf_vocabulary(reps)
    few, many = (sorted(lexical.tfidf_vectors(reps, vocabulary).select("doc", "term", F.round("w", 9)).collect()) for _ in (monkeypatch.setattr(lexical, "SENT_TERMS", 10**6), monkeypatch.setattr(lexical, "SENT_TERMS", 1)))
    assert few == many


def test_terms_are_counted_a_few_at_a_time(spark, monkeypatch):
    rows = [(None, 2), ("", 1), ("...", 3), *((t, i % 3 + 1) for i, (_, t) in enumerate(texts(80, 9)))]
    reps = spark.createDataFrame([("", i, n, t) for i, (t, n) in enumerate(rows)], "grp string, doc long, n_copies long, text string").coalesce(2)
    want = {}
    for t, n in rows:
        for w in (own := [x for x in (t or "").replace(".", "").split() if len(x) > 1 and x not in lexical.STOP_WORDS]):
            tf, df = want.get(w, (0, 0))
            want[w] = tf + n, df + (n / own.count(w))
    monkeypatch.setattr(lexical, "_COUNTED", 7)
    got = {r.term: (r.total_tf, r.df) for r in lexical.tfidf_vocabulary(reps).collect()}
    assert got == {w: (tf, round(df)) for w, (tf, df) in want.items()}


def test_postings_stay_where_they_are_when_few_terms_are_asked(spark):
    """The asked terms and the block numbers are sent to the postings' tasks; only rows of asked terms are dealt to blocks."""
    postings = materialize(spark.range(60_000).selectExpr("'' as grp", "concat('t', id % 400) as term", "id as doc", "1D as w"), "postings")
    terms = materialize(spark.range(40).selectExpr("'' as grp", "id % 4 as q", "concat('t', id) as term", "1D as qw", "10L as n_posts"), "terms")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")  # more than the written tables, less than their product
    try:
        plan = lexical._block_scores(terms, postings, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 4 and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("width, k", [(50, 4), (1000, 3), (1000, 15), (700, 900)])
def test_best_of_ranks_few_numbers_and_equals_a_full_sort(width, k):
    rng = np.random.default_rng(width + k)
    scores = np.round(rng.random((20, width)), 2)  # many ties
    scores[3], scores[4, ::2], scores[5] = -np.inf, -np.inf, 0.5
    row, col = dense.best_of(scores, k, 0.1)
    for i, own in enumerate(scores):
        want = [j for j in np.argsort(-own, kind="stable").tolist() if own[j] >= 0.1][:k]
        assert col[row == i].tolist() == want


def test_collections_do_not_mix(spark):
    docs = spark.createDataFrame([(1, "a", "red fox"), (2, "b", "red fox"), (3, "b", "blue cat")], "id long, brand string, text string")
    c = lexical.as_collection(docs, "id", "text", "brand")
    got = {(r.q, r.doc) for r in lexical.cosine_topk(c, c, 3).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_tfidf_vectors_are_unit_and_ngrams_skip_stop_words(spark):
    docs = collection(spark, [(1, "cats and dogs"), (2, "cats dogs birds"), (3, "the and")]).withColumn("n_copies", F.lit(1).cast("bigint"))
    params = lexical.TfIdf(100, 1, 2)
    vectors = lexical.tfidf_vectors(docs, lexical.tfidf_vocabulary(docs, params), params)
    terms = {(r.doc, r.term) for r in vectors.collect()}
    assert terms == {(1, "cats"), (1, "dogs"), (1, "cats dogs"), (2, "cats"), (2, "dogs"), (2, "birds"), (2, "cats dogs"), (2, "dogs birds")}
    norms = vectors.groupBy("doc").agg(F.sum(F.col("w") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)


def unit(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, d))
    if copies:
        v[:copies] = v[0]
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def vector_frames(spark, v):
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    q = spark.createDataFrame(rows, "q long, vec array<float>")
    return q, q.withColumnRenamed("q", "id")


def brute(v, k, pairing, floor):
    v = v.astype(np.float64)
    s = np.round(v @ v.T, 9)
    out = {}
    for i in range(len(v)):
        ids = [j for j in range(len(v)) if pairing == "all" or (pairing == "others" and j != i) or (pairing == "earlier" and j < i)]
        ids = sorted((j for j in ids if floor is None or s[i, j] >= floor), key=lambda j: (-s[i, j], j))[:k]
        if ids:
            out[i] = ids
    return out


@pytest.mark.parametrize("pairing,floor", [("others", None), ("earlier", 0.9), ("all", 0.97)])
@pytest.mark.parametrize("cells", [1, 7])
def test_dense_search_is_exact(spark, monkeypatch, pairing, floor, cells):
    monkeypatch.setattr(dense, "_STRIPE_ROWS", 60)
    v = unit(240, 8, 5, copies=80)
    q, c = vector_frames(spark, v)
    got = {}
    for r in dense.dense_topk(q, c, 4, floor, pairing, cells).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == brute(v, 4, pairing, floor)


def test_fusion_reports_missing_sides(spark):
    dense_list = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "q long, doc long, score double, rank int")
    lexical_list = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 0.0, 2)], "q long, doc long, score double, rank int")
    out = {r.doc: r for r in hybrid.rrf_fuse(dense_list, lexical_list).collect()}
    assert set(out) == {10, 11}
    assert out[11].rrf_score == pytest.approx(0.6 / 62 + 0.4 / 61) and out[11].rank == 1
    assert out[10].lexical_score == 0.0 and out[11].lexical_score == 5.0


def test_rerank_falls_back_when_all_are_below_the_floor(spark):
    rows = [(1, d, d, "x", p) for d, p in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))] + [(2, 5, 1, "y", "y z"), (2, 6, 2, "y", "q")]
    df = spark.createDataFrame(rows, "q long, doc long, rank int, asked string, passage string").withColumn("rrf_score", F.lit(0.1))
    settings = RetrievalSettings(rerank_floor=0.1)
    score = lambda a, b: F.when(F.contains(b, a), 0.5).otherwise(0.0)
    out = hybrid.rerank_topk(df, score, "asked", "passage", settings).orderBy("q", "rank").collect()
    assert [(r.q, r.doc) for r in out] == [(1, 1), (1, 2), (1, 3), (2, 5)]
    plain = hybrid.rerank_topk(df, None, "asked", "passage", settings)
    assert plain.count() == 5


def test_mmr_prefers_diversity_and_keeps_short_lists(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.6, 0.8])], "id long, vec array<float>")
    c = spark.createDataFrame([(1, i, 0.016 - i / 10000, i) for i in (1, 2, 3, 4)] + [(2, 1, 0.9, 1)], "q long, id long, rel double, rank int")
    out = hybrid.mmr_select(c, vectors, 3).orderBy("q", "pick").collect()
    assert [(r.q, r.id) for r in out] == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_cache_admission_respects_capacity(spark):
    df = spark.createDataFrame(
        [(1, False, False, 0.95), (2, True, False, 0.95), (3, False, True, 0.95), (4, False, False, 0.5), (5, False, False, 0.9), (6, False, False, 0.99)],
        "id long, should_escalate boolean, cached boolean, classification_confidence double",
    )
    out = hybrid.cache_admission(df, "id", CacheSettings(max_entries=4), already=2)
    assert [r.id for r in out.collect()] == [1, 5]


def test_text_clusters_find_the_topics(spark):
    """Three topics, a text without terms, an empty and a null one; the labels feed the summary."""
    topics = ["apple pear plum cherry fig", "bolt screw nail hammer drill", "violin cello flute oboe harp"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(topics[i % 3].split(), k=8)), "c") for i in range(60)] + [(60, "", "c"), (61, None, "c"), (62, "!!", "c")]
    df = spark.createDataFrame(rows, "id long, body string, cluster_ string")
    found = taxonomy.text_kmeans(df, "id", "body", k=3, starts=4)
    labels = {r.id: r.cluster for r in found.labels.collect()}
    assert len(labels) == 63 and {labels[i] for i in (60, 61, 62)} == {0}
    assert len({(i % 3, labels[i]) for i in range(60)}) == 3
    costs = found.costs.collect()
    assert len(costs) == 4 and [r.cost for r in costs if r.chosen] == [min(r.cost for r in costs)]
    lengths = found.centres.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in lengths)
    table = taxonomy.discovery(df, "id", "body", found).collect()
    assert sum(r["size"] for r in table) == 63 and {frozenset(r.top_keywords[:5]) for r in table} >= {frozenset(t.split()) for t in topics}
    again = taxonomy.text_kmeans(df.repartition(5), "id", "body", k=3, starts=4)
    assert {r.id: r.cluster for r in again.labels.collect()} == labels
    nothing = taxonomy.text_kmeans(df.filter("id >= 60"), "id", "body")
    assert {r.cluster for r in nothing.labels.collect()} == {0} and nothing.centres.count() == 0
    few = taxonomy.text_kmeans(df.filter("id < 2"), "id", "body", k=7)
    assert {r.cluster for r in few.labels.collect()} == {0, 1}


def test_an_index_refuses_what_it_was_not_built_for(spark, tmp_path):
    index = lexical.build_index(collection(spark, texts(40, 1)), 5)
    index.store(f"file://{tmp_path}/i")
    again = lexical.TextIndex.load(spark, f"file://{tmp_path}/i")
    asked = collection(spark, texts(3, 2))
    assert again.k == 5 and lexical.bm25_search(asked, again, 5).count() > 0
    for search in (lexical.bm25_search, lexical.cosine_search):
        with pytest.raises(ValueError):
            search(asked, again, 6)
    with pytest.raises(ValueError):
        lexical.TextIndex.load(spark, f"file://{tmp_path}/i", lexical.Bm25(k1=1.2))
