import pytest
from pyspark.sql import functions as F

from ticketloom.operators import language, running, sampling, skew, threads

COLUMNS = "tweet_id string, author_id string, inbound boolean, created_at string, text string, in_response_to_tweet_id string"


def tweets(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


BASE = [
    ("1", "alice", True, "d1", "Where is my parcel, please?", None),
    ("2", "ACME", False, "d1", "ok", "1"),
    ("3", "acme", False, "d1", "Please send us your order number", "1"),
    ("4", "acme", False, "d1", "Another later reply to the same message", "1"),
    ("5", "acme", False, "d1", "Reply to a reply from the brand", "3"),
    ("6", "acme", False, "d1", "Reply to a message nobody has", "99"),
    ("7", "bob", True, "d2", "荷物が届きません、助けてください", None),
    ("8", "acme", False, "d2", "We are sorry to hear about this", "7"),
    ("9", "carol", True, "d2", None, None),
    ("10", "acme", False, "d2", "Reply to an empty message here", "9"),
    ("11", "other", False, "d2", "Another brand answers this one", "1"),
]


def test_first_qualifying_reply_wins(spark):
    out = threads.thread_reconstruct(tweets(spark, BASE), ["Acme"]).collect()
    assert [(r.thread_id, r.brand, r.turn_count) for r in out] == [("thread_1_3", "Acme", 2)]


def test_language_flag_per_brand(spark):
    df = tweets(spark, BASE + [("12", "other", False, "d3", "Sorry, we cannot read this", "7")])
    out = threads.thread_reconstruct(df, ["acme", "other"], {"acme": False, "other": True})
    assert sorted(r.thread_id for r in out.collect()) == ["thread_1_11", "thread_1_3", "thread_7_8"]


def test_detector_outcome_is_used(spark):
    none = spark.createDataFrame([], "tweet_id string")
    assert threads.thread_reconstruct(tweets(spark, BASE), ["acme"], english_ids=none).count() == 0


def test_limit_keeps_the_earliest(spark):
    rows = []
    for i in range(1, 40, 2):
        rows += [(str(i), "u", True, "d", f"customer message number {i}", None)]
        rows += [(str(i + 1), "acme", False, "d", f"brand reply number {i}", str(i))]
    out = threads.thread_reconstruct(tweets(spark, rows), ["acme"], max_threads=3).collect()
    assert sorted(int(r.agent_tweet_id) for r in out) == [2, 4, 6]


def test_duplicate_ids_are_reported(spark):
    assert [r.tweet_id for r in threads.duplicate_ids(tweets(spark, BASE + [BASE[0]])).collect()] == ["1"]


def test_long_chains_forks_and_cycles(spark):
    chain = [(str(i), "u", True, "d", "t", str(i - 1) if i else None) for i in range(70)]
    fork = [(f"{i}", "u", True, "d", "t", "5") for i in range(100, 160)]
    cycle = [("a", "u", True, "d", "t", "b"), ("b", "u", True, "d", "t", "a"), ("c", "u", True, "d", "t", "a")]
    orphan = [("z", "u", True, "d", "t", "missing")]
    df = tweets(spark, chain + fork + cycle + orphan)
    got = {r.tweet_id: (r.root_id, r.depth, r.cycle) for r in threads.thread_multi_hop(df, rows_per_task=10).collect()}
    want = {str(i): ("0", i, False) for i in range(70)}
    want |= {str(i): ("0", 6, False) for i in range(100, 160)}
    want["z"] = ("z", 0, False)
    want |= {x: (None, None, True) for x in "abc"}
    assert got == want


def test_turns_of_a_long_thread_come_in_pieces(spark):
    """A chain, a message with thousands of answers, a cycle, a repeated id and a pointer to nothing."""
    rows = [(str(i), f"u{i % 3}", i % 2 == 0, "d", f"t{i}", str(i - 1) if i else None) for i in range(60)]
    rows += [(str(i), "x", False, None, None, "1000") for i in range(1001, 4001)] + [("1000", "root", True, "d", "t", "gone")]
    rows += [("a", "u", True, "d", "t", "b"), ("b", "u", True, "d", "t", "a"), ("5", "again", True, "d", "z", "4")]
    df = tweets(spark, rows)
    got = threads.thread_turns(df, piece_turns=7).collect()
    assert all(1 <= len(r.turns) <= 7 and r.first_position == r.piece_no * 7 + 1 for r in got)
    by_root = {}
    for r in sorted(got, key=lambda r: r.first_position):
        by_root.setdefault(r.root_id, []).extend(r.turns)
    assert by_root.keys() == {"0", "1000"}
    assert [t.tweet_id for t in by_root["0"]] == [str(i) for i in range(60)]
    assert [t.tweet_id for t in by_root["1000"]] == [str(i) for i in range(1000, 4001)]
    assert [t.position for t in by_root["1000"]] == list(range(1, 3002))
    assert [t.depth for t in by_root["1000"]] == [0] + [1] * 3000
    assert {t.text for t in by_root["0"] if t.tweet_id == "5"} == {"t5"}
    assert threads.thread_turns(df.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_a_plain_join(spark, how):
    left = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.salted_lookup(left, right, "k", "row", how, rows_per_task=100).select("row", "k", "v")
    want = left.join(right, "k", how).select("row", "k", "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert skew.hot_keys(left, "k", 100).count() == 1


def test_running_values_cross_buckets(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").alias("t"),
        (F.col("id") % 4).alias("w"),
    )
    got = running.running_count(df, ["k"], ["t"], F.floor(F.col("t") / 20), "n", F.col("w"))
    got = running.previous_row(got, ["k"], ["t"], F.floor(F.col("t") / 20), ["w"])
    state = {}
    for r in got.orderBy("t").collect():
        total, last = state.get(r.k, (0, None))
        assert (r.n, r.prev_w) == (total + r.w, last)
        state[r.k] = (total + r.w, r.w)


def test_a_run_of_fragments_is_one_row(spark):
    rows = [(1, i, "a" if i < 5 else "b", "x" * 15_000) for i in range(8)]
    df = spark.createDataFrame(rows, "conv long, turn long, who string, text string")
    out = threads.merge_fragments(df, "conv", "turn", "who", "text").orderBy("fragment_no").collect()
    assert [(r.fragment_no, r.who, r.n_messages, r.text.count("x")) for r in out] == [(1, "a", 5, 75_000), (2, "b", 3, 45_000)]


def test_repeated_ids_give_one_thread(spark):
    again = tweets(spark, BASE + BASE)
    once = tweets(spark, BASE)
    assert threads.thread_reconstruct(again, ["Acme"]).count() == threads.thread_reconstruct(once, ["Acme"]).count() == 1
    assert threads.thread_multi_hop(again).count() == len({r[0] for r in BASE})


def test_turns_follow_time_not_text(spark):
    dates = ["Fri Nov 03 10:00:00 +0000 2017", "Tue Oct 31 09:00:00 +0000 2017", "Wed Nov 01 08:00:00 +0000 2017", "2017-11-02 07:00:00", None]
    rows = [(str(i), "u", True, d, "t", None) for i, d in enumerate(dates)]
    out = {r.tweet_id: r.turn_no for r in threads.turn_counter(tweets(spark, rows)).collect()}
    assert out == {"4": 1, "1": 2, "2": 3, "3": 4, "0": 5}


def test_language_profile_and_sentiment(spark):
    docs = spark.createDataFrame(
        [(1, "en", "the cat and the dog"), (2, "de", "der hund und die katze"), (3, "de", "und der vogel")],
        "id long, lang string, text string",
    )
    profile = language.learn_profile(docs, "lang", "text")
    fresh = spark.createDataFrame([(1, "the bird and"), (2, "und der"), (3, "zzz qqq www"), (4, "おはようございます")], "id long, text string")
    kept = {r.id: r.is_kept for r in language.language_filter(fresh, "id", "text", profile).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: False}
    lexicon = spark.createDataFrame([("bad", -2.0)], "word string, valence double")
    scores = {r.id: r.sentiment for r in language.with_sentiment(fresh.union(spark.createDataFrame([(5, "bad bad")], fresh.schema)), "id", "text", lexicon).collect()}
    assert scores[5] == pytest.approx(-4 / (16 + 15) ** 0.5) and scores[1] == 0.0


def test_samples_and_splits_ignore_partitioning(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = {r.id for r in sampling.seeded_sample(df, "id", 50).collect()}
    b = {r.id for r in sampling.seeded_sample(df.repartition(13), "id", 50).collect()}
    assert a == b and len(a) == 50
    counts = {
        (r.y, r.split): r["count"] for r in sampling.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()
    }
    assert counts == {(0, "test"): 167, (0, "train"): 499, (1, "test"): 84, (1, "train"): 250}
