import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from ticketloom import schemas
from ticketloom.config import CacheSettings
from ticketloom.functions import hooks
from ticketloom.operators import language, lexical
from ticketloom.operators.threads import turn_counter
from ticketloom.plans import queries, scoring
from ticketloom.plans.queries import QUERIES
from ticketloom.session import scratch_path, shared_dir
from ticketloom.sources import files, quoted
from ticketloom.sources.tables import Tables
from ticketloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp"


def batches(spark, name, schema, *parts):
    """A folder of Parquet files whose order of arrival is the order of ``parts``."""
    path = scratch_path(spark, name)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, names="*.parquet")


def run(spark, stream):
    return jobs.run_to_table(stream, scratch_path(spark, "out"), scratch_path(spark, "ckpt")).collect()


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_late_rows_are_dropped(spark):
    s = batches(
        spark, "ev", EVENTS, [(1, 1, at(0)), (2, 1, at(300))], [(3, 1, at(400))], [(4, 1, at(5))], [(5, 1, at(900))]
    )
    out = run(spark, jobs.volume(s, "user_id"))
    assert {(r.window_start, r.n) for r in out} == {(at(0), 1), (at(300), 1), (at(360), 1)}


def test_sessions_close_by_gap(spark):
    s = batches(spark, "ev", EVENTS, [(1, 1, at(0)), (2, 1, at(10)), (3, 1, at(50)), (4, 2, at(5))], [(5, 3, at(500))])
    out = run(spark, jobs.fragment_sessions(s, "user_id"))
    assert sorted((r.user_id, r.n) for r in out) == [(1, 1), (1, 2), (2, 1)]


def test_reply_meets_parent_within_the_horizon(spark):
    parents = batches(spark, "p", "parent_id string, parent_ts timestamp", [("a", at(0)), ("b", at(0))])
    replies = batches(
        spark, "r", "reply_id string, parent_ref string, reply_ts timestamp",
        [("r1", "a", at(30)), ("r2", "b", at(180)), ("r3", "a", at(110))],
    )
    out = run(spark, jobs.thread_join(replies, parents).select("reply_id", "parent_id"))
    assert sorted((r.reply_id, r.parent_id) for r in out) == [("r1", "a"), ("r3", "a")]


def test_duplicates_across_batches(spark):
    s = batches(
        spark, "r", "reply_id string, parent_ref string, reply_ts timestamp",
        [("r1", "a", at(0))], [("r2", "a", at(10)), ("r3", "b", at(11))],
    )
    assert sorted(r.parent_ref for r in run(spark, jobs.dedup_replies(s))) == ["a", "b"]


def test_turns_follow_event_time_across_shuffled_files(spark):
    """Rows out of order within the delay, one behind the watermark, and rows that still wait at the end."""
    s = batches(
        spark, "ev", EVENTS,
        [(1, 1, at(9)), (2, 1, at(2)), (3, 2, at(5))],
        [(4, 1, at(5)), (5, 1, at(2)), (6, 2, at(15))],
        [(7, 1, at(30)), (8, 2, at(12))],
        [(9, 1, at(3)), (10, 1, at(50))],
    )
    out = run(spark, jobs.turn_state(s, "user_id", "event_id"))
    assert sorted((r.user_id, r.turn_no, r.event_id, r.turn_trigger) for r in out) == [
        (1, 1, 2, False), (1, 2, 5, False), (1, 3, 4, True), (1, 4, 1, True), (1, 5, 7, True),
        (2, 1, 3, False), (2, 2, 8, False), (2, 3, 6, True),
    ]


def test_an_idle_key_starts_again(spark):
    s = batches(spark, "ev", EVENTS, [(1, 1, at(0))], [(2, 2, at(100))], [(3, 2, at(200))], [(4, 1, at(300))], [(5, 2, at(400))])
    out = run(spark, jobs.turn_state(s, "user_id", "event_id", idle_ms=60_000))
    assert {(r.event_id, r.turn_no) for r in out} >= {(1, 1), (4, 1)}


def test_only_reachable_partitions_of_the_cache_are_read(spark):
    centres = np.eye(4)
    schema = "q long, vec array<float>, intent string, draft_reply string, confidence double, should_escalate boolean"

    def near(q, i):
        v = np.full(4, 0.01)
        v[i] = 1.0
        return (q, [float(x) for x in v / np.linalg.norm(v)], f"i{q}", "r", 0.95, False)

    stream = batches(spark, "t", schema, [near(i, i % 4) for i in range(8)], [near(8, 1)], [near(9, 1), near(10, 2)])
    cache, answers = scratch_path(spark, "cache"), scratch_path(spark, "answers")
    jobs.cache_batches(stream, cache, answers, scratch_path(spark, "ckpt"), CacheSettings(0.97, 0.9), centres)
    assert {r.q: r.cache_id for r in spark.read.parquet(answers).collect() if r.q > 7} == {8: 1, 9: 1, 10: 2}
    states = spark.read.parquet(f"{cache}-cells").filter("batch = 1").collect()
    assert {r.cell: r.n for r in states} == {0: 2, 1: 2, 2: 2, 3: 2}
    radius = np.array([r.radius for r in sorted(states, key=lambda r: r.cell)])
    query = spark.createDataFrame([near(9, 1)], schema)
    assert jobs.open_cells(query, centres, radius, 0.97) == [1]
    assert jobs.open_cells(query, centres, radius, -0.5) == [0, 1, 2, 3]
    scan = jobs.reachable(spark, cache, 2, [1])
    plan = scan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and len(scan.inputFiles()) > 1
    assert {f for f in scan.select(F.input_file_name()).distinct().toPandas().iloc[:, 0] if "cell=1" not in f} == set()


def test_scores_of_arriving_tickets_equal_the_batch_and_replay(spark):
    d = "/root/testdata/sf0.001"
    t = Tables(spark, d)
    threads = queries.stored_threads(t)
    tickets = queries.tickets_of(threads).limit(24).cache()
    index = queries._stored_index(t)
    want = scoring.score_tickets(tickets, index["corpus"], t.intents, t.lexicon, queries.classify, None, index=index["text"])
    rows = [r for r in tickets.collect()]
    stream = batches(spark, "tk", tickets.schema, rows[:10], rows[10:11], rows[11:])
    answers = scratch_path(spark, "answers")

    def flat(df):
        contexts = F.transform("retrieved_context", lambda c: F.concat_ws(":", c["passage_id"], F.round(c["rerank_score"], 6)))
        return df.withColumn("retrieved_context", F.array_join(contexts, ","))

    for _ in range(2):  # the second run replays all batches
        jobs.score_batches(stream, answers, scratch_path(spark, "ckpt"), index, t.intents, t.lexicon, queries.classify)
        got = spark.read.parquet(answers).drop("batch")
        assert got.count() == len(rows) and flat(got).exceptAll(flat(want)).count() == 0


def test_cache_serves_later_batches_and_replays(spark):
    schema = "q long, vec array<float>, intent string, draft_reply string, confidence double, should_escalate boolean"
    first = [(1, [1.0, 0.0], "i1", "r", 0.95, False), (2, [0.0, 1.0], "i2", "r", 0.5, False), (3, [1.0, 0.0], "i3", "r", 0.95, False)]
    second = [(4, [1.0, 0.0], "i4", "r", 0.95, False), (5, [0.0, 1.0], "i5", "r", 0.95, False), (6, [0.6, 0.8], "i6", "r", 0.99, True)]
    stream = batches(spark, "t", schema, first, second)
    cache, answers = scratch_path(spark, "cache"), scratch_path(spark, "answers")

    def contents():
        c = sorted((r.batch, r.id) for r in spark.read.parquet(cache).collect())
        a = {r.q: r.cache_id for r in spark.read.parquet(answers).collect()}
        return c, a

    jobs.cache_batches(stream, cache, answers, scratch_path(spark, "ckpt"), CacheSettings(0.97, 0.9))
    once = contents()
    assert once == ([(0, 1), (0, 3), (1, 5)], {1: None, 2: None, 3: None, 4: 1, 5: None, 6: None})
    jobs.cache_batches(stream, cache, answers, scratch_path(spark, "ckpt"), CacheSettings(0.97, 0.9))
    assert contents() == once


def test_csv_with_newlines_and_quotes(spark):
    rows = [("1", "u", "True", "d", 'line one\nline "two", end', None, None), ("2", "b", "false", "d", "x", None, "1")]
    path = scratch_path(spark, "csv")
    columns = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string"
    spark.createDataFrame(rows, columns).write.option("header", True).option("escape", '"').csv(path)
    out = {r.tweet_id: r for r in files.scan_tweets_csv(spark, path).collect()}
    assert out["1"].text == 'line one\nline "two", end' and out["1"].inbound is True
    assert out["2"].inbound is False and out["1"].in_response_to_tweet_id is None


def test_a_csv_file_is_read_in_splits(spark, tmp_path):
    """Quotes and line breaks wherever a byte range may end, against the reader that takes a file whole."""
    values = ["", "x", 'say "hi"', "two\nlines", '"', '""', 'a\n"b"\n\nc', "é\r\n日本", ",", '\n"', "end\n", None, "\r"]
    columns = [f.name for f in schemas.TWEETS_CSV.fields]

    def field(v, i):
        return "" if v is None else '"' + v.replace('"', '""') + '"' if v == "" or set(v) & set('",\n\r') or i % 7 == 0 else v

    for name, rows, end in (("a", 400, "\n"), ("b", 90, "\r\n"), ("c", 0, "\n")):
        out = [",".join(columns)]
        for i in range(rows):
            row = [str(i), "u", "True", "d", values[i % len(values)], values[i * 5 % len(values)], values[i * 3 % 11]]
            out.append(",".join(field(v, i) for v in row))
            if i % 50 == 9:
                out.append("")
        (tmp_path / f"{name}.csv").write_bytes(end.join(out).encode() + (b"\n" if name == "a" else b""))
    whole = spark.read.schema(schemas.TWEETS_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))

    def rows_of(df):  # the other reader turns \\r\\n in quotes into \\n
        return sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in df.collect()), key=str)

    want = rows_of(whole)
    assert len(want) == 490
    key, tasks = "spark.sql.files.maxPartitionBytes", set()
    for size in ("331", "128m"):
        spark.conf.set(key, size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = quoted.read_quoted_csv(spark, str(tmp_path), schemas.TWEETS_CSV)
            tasks.add(spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions())
            assert rows_of(got) == want
            assert got.filter("response_tweet_id like '%\\r\\n%'").count()
        finally:
            spark.conf.unset(key)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert max(tasks) > 30


def test_jsonl_skips_blank_lines(spark, tmp_path):
    line = {"passage_id": "p", "brand": "b", "customer_query": "q", "historical_resolution": "r"}
    texts = [json.dumps({**line, "passage_id": f"p{i}"}) for i in (3, 1, 2)]
    (tmp_path / "c.jsonl").write_text(texts[0] + "\n\n" + texts[1] + "\n" + texts[2] + "\n")
    assert files.scan_corpus_jsonl(spark, str(tmp_path)).count() == 3
    assert sorted(r.passage_id for r in files.scan_corpus_jsonl(spark, str(tmp_path), 2).collect()) == ["p1", "p2"]


def test_params_defaults_and_index_check(spark):
    path = scratch_path(spark, "params")
    files.sink_params(spark.createDataFrame([(0.05, 0.2)], "alpha double, q_hat double"), path)
    r = files.load_params(spark, path).first()
    assert (r.temperature, r.thresholds, r.q_hat) == (1.0, None, 0.2)
    with pytest.raises(FileNotFoundError):
        files.load_index(spark, path)


def test_a_stored_index_is_searched_as_a_fresh_one(spark):
    docs = spark.createDataFrame(
        [("", i, t) for i, t in enumerate(["parcel late today", "late refund form", "parcel late today", "form driver wallet", "battery"])], "grp string, doc long, text string"
    )
    asked = spark.createDataFrame([("", 0, "late refund"), ("", 1, "wallet battery drain")], "grp string, doc long, text string")
    fresh, path = lexical.build_index(docs, 3), scratch_path(spark, "index")
    files.sink_index(path, docs, docs, fresh)
    loaded = files.load_index(spark, path)["text"]
    for search in (lexical.bm25_search, lexical.cosine_search):
        want = sorted(map(tuple, search(asked, fresh, 3).collect()))
        assert want and sorted(map(tuple, search(asked, loaded, 3).collect())) == want


def test_sentiment_moves_no_text(spark):
    docs = spark.createDataFrame([(1, "good good bad"), (2, "nothing"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -3.0), ("bad", 0.5)], "word string, valence double")
    out = language.with_sentiment(docs, "id", "text", lexicon)
    assert {r.id: round(r.sentiment, 6) for r in out.collect()} == {1: round(-0.5 / (0.25 + 15) ** 0.5, 6), 2: 0.0, 3: 0.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if " Exchange" in x and "BroadcastExchange" not in x]
    assert all("text" not in x for x in moved)


def test_reuse_does_not_rebuild(spark):
    path, built = scratch_path(spark, "table"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert files.reuse_or_build(spark, path, build).count() == 1
    assert files.reuse_or_build(spark, path, build).count() == 1
    assert files.reuse_or_build(spark, path, build, force=True).count() == 2


def test_model_hooks(spark):
    df = spark.createDataFrame([("a b", "a"), ("c", "d")], "x string, y string")
    embed = hooks.embedder(lambda: lambda texts: [[float(len(t))] for t in texts])
    score = hooks.pair_scorer(lambda: lambda a, b: a.str.len() - b.str.len())
    lang = hooks.language_detector(lambda: lambda texts: texts.map(lambda _: "en"))
    out = df.select(embed("x").alias("e"), score("x", "y").alias("s"), lang("x").alias("l")).collect()
    assert [(r.e, r.s, r.l) for r in out] == [([3.0], 2.0, "en"), ([1.0], 0.0, "en")]
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("confidence", T.DoubleType())])
    answers = hooks.generate(df, lambda: lambda b: b.assign(confidence=b.x.str.len() / 2.0), schema, "confidence between 0 and 1")
    assert {r.x: r.quarantined for r in answers.collect()} == {"a b": True, "c": False}


def test_stream_turns_equal_batch_turns(spark):
    rows = [(str(i), f"u{i % 5}", True, f"2024-01-0{1 + i // 30}", "t", None) for i in range(90)]
    tweets = spark.createDataFrame(
        rows, "tweet_id string, author_id string, inbound boolean, created_at string, text string, in_response_to_tweet_id string"
    )
    batch = {r.tweet_id: r.turn_no for r in turn_counter(tweets).collect()}
    schema = "tweet_id long, author_id string, ts timestamp"
    closing = [[(1000, "last", at(500))], [(1001, "last", at(900))]]  # moves the watermark past all others
    s = batches(spark, "tw", schema, *[[(i, f"u{i % 5}", at(i)) for i in range(a, a + 30)][::-1] for a in (0, 30, 60)], *closing)
    out = run(spark, jobs.turn_state(s, "author_id", "tweet_id", delay="40 minutes"))
    assert {str(r.tweet_id): r.turn_no for r in out if r.tweet_id < 1000} == batch


def test_registered_ml_queries(spark):
    d = "/root/testdata/sf0.001"
    clusters = QUERIES["kmeans_intents"](spark, d).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in clusters) == 500 and len(clusters) == 7
    out = QUERIES["intent_logreg"](spark, d)
    # the labels of these vectors are noise, so only the fitted rows can beat the largest class
    fitted = out.filter("split = 'train'")
    hit = fitted.agg(F.avg((F.col("predicted") == F.col("y")).cast("int")).alias("a")).first().a
    assert hit > 0.2 and out.count() == 500


def test_malformed_lines_are_an_error(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"passage_id": "p1"}\n{"passage_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_corpus_jsonl(spark, str(tmp_path)).collect()


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_the_cache_is_searched_once_for_all_steps(spark, monkeypatch):
    """What follows the cache reads its written hits, so their search is no part of the later plan."""
    tickets = spark.createDataFrame([("a", "b", "red fox", 1), ("c", "b", "blue cat", 1)], "ticket_id string, brand string, query string, turn_count int")
    corpus = tickets.selectExpr("concat('p', ticket_id) as passage_id", "brand", "query as customer_query", "query as historical_resolution")
    intents = spark.createDataFrame([("b", "other", "Other", 0, True)], "brand string, intent_id string, name string, ord int, auto_handle_eligible boolean")
    cache = tickets.limit(1).selectExpr("'k' as cache_id", "brand", "query", "'other' as intent", "'hello' as draft_reply")
    found = scoring.text_cache_hits
    monkeypatch.setattr(scoring, "text_cache_hits", lambda *a: found(*a).filter("ticket_id != 'searched again'"))
    out = scoring.score_tickets(tickets, corpus, intents, spark.createDataFrame([("x", 1.0)], "word string, valence double"), lambda text: F.lit("other"), cache)
    assert "searched again" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.ticket_id, r.cached) for r in out.collect()} == {("a", True), ("c", False)}
