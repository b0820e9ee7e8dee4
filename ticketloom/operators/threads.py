"""Rebuilding conversations from reply pointers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ticketloom.functions import text as X
from ticketloom.operators.running import previous_row, running_count
from ticketloom.operators.skew import salted_lookup
from ticketloom.session import materialize


def parse_inbound(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c.cast("string")) == "true"


def has_text(c: str) -> Column:
    """Null counts as empty."""
    return F.col(c).isNotNull() & (F.col(c) != "")


def brand_name(author: str, brands: Sequence[str]) -> Column:
    """The configured brand an author stands for, ignoring case; null for others."""
    return F.coalesce(
        *[F.when(F.lower(author) == b.lower(), F.lit(b)) for b in brands]
    )


def brand_replies(tweets: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Outbound messages of the configured brands, all brands in one pass."""
    lowered = [b.lower() for b in brands]
    return tweets.filter(
        ~F.col("inbound") & F.lower("author_id").isin(lowered)
    ).withColumn("brand", brand_name("author_id", brands))


def duplicate_ids(tweets: DataFrame) -> DataFrame:
    """Message ids that occur more than once; a clean input gives no rows."""
    return tweets.groupBy("tweet_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def reply_parent_join(tweets: DataFrame, brands: Sequence[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """Every brand reply next to the customer message it answers.

    A message with very many replies is split over tasks.
    """
    replies = (
        brand_replies(tweets, brands)
        .filter(F.col("in_response_to_tweet_id").isNotNull())
        .select(
            F.col("in_response_to_tweet_id").alias("parent_id"),
            "brand",
            F.col("tweet_id").alias("reply_id"),
            F.col("text").alias("reply_text"),
        )
    )
    # a repeated id is one message: the smallest of its rows
    parents = (
        tweets.filter("inbound")
        .groupBy(F.col("tweet_id").alias("parent_id"))
        .agg(F.min(F.struct(F.col("author_id").alias("customer_id"), F.col("text").alias("parent_text"))).alias("m"))
        .select("parent_id", "m.*")
    )
    return salted_lookup(replies, parents, "parent_id", "reply_id", "inner", rows_per_task)


def first_reply(replies: DataFrame) -> DataFrame:
    """First reply, by numeric id, per brand and customer message.

    A plain aggregate, so a message with many replies shrinks before the shuffle.
    """
    others = [c for c in replies.columns if c not in ("brand", "parent_id")]
    ordinal = F.col("reply_id").cast("long")
    picked = replies.groupBy("brand", "parent_id").agg(
        F.min_by(F.struct(*others), ordinal).alias("r")
    )
    return picked.select("brand", "parent_id", "r.*")


def thread_reconstruct(
    tweets: DataFrame,
    brands: Sequence[str],
    filter_non_english: bool | Mapping[str, bool] = True,
    english_ids: DataFrame | None = None,
    max_threads: int | None = None,
    full_entities: bool = True,
) -> DataFrame:
    """Threads of all brands in one pass.

    Replies are cleaned, filtered and reduced to the first qualifying one per
    customer message *before* the join, which is then unique on both sides.
    ``english_ids`` (``tweet_id``) may carry the outcome of a language detector;
    without it only the script test applies.
    """
    replies = (
        brand_replies(tweets, brands)
        .filter(F.col("in_response_to_tweet_id").isNotNull() & has_text("text"))
        .select(
            "brand",
            F.col("in_response_to_tweet_id").alias("parent_id"),
            F.col("tweet_id").alias("reply_id"),
            X.clean_message("text", full_entities).alias("agent_reply"),
            F.col("created_at").alias("agent_created_at"),
        )
        .filter(F.length("agent_reply") >= 10)
    )
    parents = (
        tweets.filter(F.col("inbound") & has_text("text"))
        .select(
            F.col("tweet_id").alias("parent_id"),
            F.col("author_id").alias("customer_author_id"),
            F.col("created_at").alias("customer_created_at"),
            X.is_western_script("text").alias("english"),
            X.clean_message("text", full_entities).alias("customer_query"),
        )
        .filter(F.length("customer_query") >= 10)
    )
    # a repeated id is one message: the smallest of its rows
    others = [c for c in parents.columns if c != "parent_id"]
    parents = parents.groupBy("parent_id").agg(F.min(F.struct(*others)).alias("m")).select("parent_id", "m.*")
    if english_ids is not None:
        flagged = english_ids.select(
            F.col("tweet_id").alias("parent_id"), F.lit(True).alias("detected")
        )
        parents = parents.join(flagged, "parent_id", "left").withColumn(
            "english", F.col("english") & F.coalesce("detected", F.lit(False))
        ).drop("detected")
    flags = (
        dict.fromkeys(brands, filter_non_english)
        if isinstance(filter_non_english, bool)
        else {b: filter_non_english.get(b, True) for b in brands}
    )
    if all(flags.values()):
        parents = parents.filter("english")
    joined = first_reply(replies).join(parents, "parent_id")
    if not all(flags.values()):
        filtered = [b for b, on in flags.items() if on]
        joined = joined.filter(~F.col("brand").isin(filtered) | F.col("english"))
    threads = joined.select(
        F.concat_ws("_", F.lit("thread"), "parent_id", "reply_id").alias("thread_id"),
        "brand",
        F.col("parent_id").alias("customer_tweet_id"),
        "customer_author_id",
        "customer_created_at",
        "customer_query",
        F.col("reply_id").alias("agent_tweet_id"),
        "agent_reply",
        "agent_created_at",
        F.lit(2).alias("turn_count"),
    )
    return limit_threads(threads, max_threads) if max_threads else threads


def limit_threads(threads: DataFrame, n: int) -> DataFrame:
    """The first n threads of each brand in reply order."""
    w = W.partitionBy("brand").orderBy(F.col("agent_tweet_id").cast("long"))
    return threads.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def corpus_of(threads: DataFrame) -> DataFrame:
    return threads.select(
        F.concat(F.lit("passage_"), "thread_id").alias("passage_id"),
        "brand",
        "customer_query",
        F.col("agent_reply").alias("historical_resolution"),
    )


def openings_of(threads: DataFrame) -> DataFrame:
    return threads.select(
        "thread_id",
        "customer_tweet_id",
        "customer_query",
        F.col("customer_created_at").alias("created_at"),
    )


def ingest_stats(threads: DataFrame, filter_applied: bool | dict[str, bool] = True) -> DataFrame:
    """Counts of each brand; ``filter_applied`` says, for all or by brand, whether the language filter ran."""
    flag = F.lit(filter_applied) if isinstance(filter_applied, bool) else F.lit(True)
    for brand, on in (filter_applied.items() if isinstance(filter_applied, dict) else ()):
        flag = F.when(F.col("brand") == brand, F.lit(on)).otherwise(flag)
    return threads.groupBy("brand").agg(
        F.count("*").alias("total_threads_reconstructed"),
        F.count("*").alias("total_rag_passages"),
        F.coalesce(F.avg(F.length("customer_query")), F.lit(0.0)).alias("avg_customer_query_length_chars"),
    ).withColumn("language_filter_applied", flag)


def ingest_rollup(threads: DataFrame) -> DataFrame:
    """``(level, brand, day, n_threads, avg_query_chars)`` by brand and day, by brand, and in total.

    ``level`` tells a row of all brands from the row of a null one.
    """
    dated = threads.select("brand", F.to_date(message_time("customer_created_at")).alias("day"), F.length("customer_query").alias("chars"))
    level = F.when(F.grouping("brand") == 1, "total").when(F.grouping("day") == 1, "brand").otherwise("day")
    return dated.rollup("brand", "day").agg(level.alias("level"), F.count("*").alias("n_threads"), F.avg("chars").alias("avg_query_chars"))


def thread_multi_hop(tweets: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """``(tweet_id, root_id, depth, cycle)`` for reply chains of any length.

    Pointers double each round, so depth d takes about log2(d) rounds.  Rows that
    reached their root leave the loop, and every round is written to the shared
    folder, which also cuts the lineage.  A round in which no row reaches a root
    shows that no deeper one exists: what is left answers a cycle and
    comes back with ``cycle`` set and no root.  A repeated id counts once, with its smallest pointer.
    """
    ids = tweets.groupBy("tweet_id").agg(F.min("in_response_to_tweet_id").alias("ptr"))
    known = ids.select(F.col("tweet_id").alias("ptr"), F.lit(True).alias("known"))
    replies = ids.filter(F.col("ptr").isNotNull())
    linked = salted_lookup(replies, known, "ptr", "tweet_id", "left", rows_per_task).select(
        "tweet_id", F.when(F.col("known"), F.col("ptr")).alias("ptr")
    )
    start = linked.unionByName(ids.filter(F.col("ptr").isNull()))
    state = materialize(
        start.select(
            "tweet_id",
            F.coalesce("ptr", "tweet_id").alias("ptr"),
            F.when(F.col("ptr").isNull(), 0).otherwise(1).alias("dist"),
            F.col("ptr").isNull().alias("done"),
        ),
        "hops",
    )
    before, left = -1, state.filter(~F.col("done")).count()
    while left and left != before:
        ahead = state.select(
            F.col("tweet_id").alias("ptr"),
            F.col("ptr").alias("next_ptr"),
            F.col("dist").alias("next_dist"),
            F.col("done").alias("next_done"),
        )
        moved = salted_lookup(
            state.filter(~F.col("done")), ahead, "ptr", "tweet_id", "inner", rows_per_task
        ).select(
            "tweet_id",
            F.col("next_ptr").alias("ptr"),
            # beyond a cycle distances only grow; they are not reported
            F.least(F.col("dist") + F.col("next_dist"), F.lit(1 << 30)).alias("dist"),
            F.col("next_done").alias("done"),
        )
        state = materialize(state.filter("done").unionByName(moved), "hops")
        before, left = left, state.filter(~F.col("done")).count()
    return state.select(
        "tweet_id",
        F.when(F.col("done"), F.col("ptr")).alias("root_id"),
        F.when(F.col("done"), F.col("dist")).cast("long").alias("depth"),
        (~F.col("done")).alias("cycle"),
    )


def thread_turns(tweets: DataFrame, hops: DataFrame | None = None, piece_turns: int = 1000) -> DataFrame:
    """Whole conversations as ordered turns: ``(root_id, piece_no, first_position, turns)``.

    Turns are in order of depth, then of the number in the id; a piece holds ``piece_turns`` of them as structs of position,
    tweet_id, depth, author_id, inbound, created_at and text, so a thread of any length is no single row.
    ``hops`` is the outcome of :func:`thread_multi_hop`.  Messages on or behind a cycle belong to no root and are left out.
    A repeated id counts once, as there; of its rows the one with the smallest pointer, then date and text, is taken.

    Positions come from a range partitioning by root and order: a busy thread lies in several
    partitions, and each takes up the count of those before it.
    """
    hops = thread_multi_hop(tweets) if hops is None else hops
    order = ["depth", "_number", "tweet_id"]
    rooted = hops.filter(F.col("root_id").isNotNull()).select("tweet_id", "root_id", "depth", F.expr("try_cast(tweet_id as bigint)").alias("_number"))
    ranged = rooted.repartitionByRange("root_id", *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "thread-ranges")
    sizes = ranged.groupBy("root_id", "_range").agg(F.count("*").alias("n"))
    before = W.partitionBy("root_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = sizes.select("root_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_carried"))
    within = F.row_number().over(W.partitionBy("root_id", "_range").orderBy(*order))
    placed = ranged.withColumn("_at", within).join(carried, ["root_id", "_range"]).select(
        "tweet_id", "root_id", "depth", (F.col("_carried") + F.col("_at")).alias("position")
    )
    fields = ["author_id", "inbound", "created_at", "text"]
    pointer = F.col("in_response_to_tweet_id")
    first = F.min_by(F.struct(*fields), F.struct(pointer.isNull(), pointer, "created_at", "text"))
    messages = tweets.groupBy("tweet_id").agg(first.alias("m"))
    turn = F.struct("position", "tweet_id", "depth", *[F.col(f"m.{c}").alias(c) for c in fields])
    piece = F.floor((F.col("position") - 1) / piece_turns).cast("long").alias("piece_no")
    pieces = placed.join(messages, "tweet_id").select("root_id", piece, "position", turn.alias("turn"))
    return pieces.groupBy("root_id", "piece_no").agg(
        F.min("position").alias("first_position"), F.array_sort(F.collect_list("turn")).alias("turns")
    )


# The forms in which exports state a time.
TIME_FORMS = ("EEE MMM dd HH:mm:ss Z yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss")


def message_time(c: str | Column) -> Column:
    """The moment that a message's date names; dates of an unknown form are null.

    Day names are left aside: the date itself decides.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(c.cast("string"), r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f.removeprefix("EEE "))) for f in TIME_FORMS])


def turn_counter(
    tweets: DataFrame, key: str = "author_id", max_turns: int = 3
) -> DataFrame:
    """Customer turns so far per ``key`` in order of time, and whether the turn limit is reached.

    Messages are ordered within hours; hours carry their counts, so a busy author is no single task.
    """
    customer = tweets.filter("inbound").withColumns(
        {"_ord": F.col("tweet_id").cast("long"), "_time": message_time("created_at")}
    )
    counted = running_count(customer, [key], ["_time", "_ord"], F.date_trunc("hour", "_time"), "turn_no")
    return counted.drop("_ord", "_time").withColumn("turn_trigger", F.col("turn_no") >= max_turns)


def merge_fragments(messages: DataFrame, key: str, order: str, author: str, text: str) -> DataFrame:
    """Join an author's consecutive messages into one row, whatever its length.

    ``(key, fragment_no, author, first_order, n_messages, text)``.
    """
    bucket = F.floor(F.col(order) / 1000)
    linked = previous_row(messages, [key], [order], bucket, [author])
    starts = F.when(F.col(f"prev_{author}").eqNullSafe(F.col(author)), 0).otherwise(1)
    numbered = running_count(linked, [key], [order], bucket, "fragment_no", starts)
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return (
        numbered.groupBy(key, "fragment_no")
        .agg(
            F.first(author).alias(author),
            F.min(order).alias("first_order"),
            F.count("*").alias("n_messages"),
            pieces.alias("_p"),
        )
        .withColumn("text", F.array_join(F.transform("_p", lambda p: p[text]), "\n"))
        .drop("_p")
    )
