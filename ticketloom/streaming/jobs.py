"""The same logic on streams.

Every job takes and gives a streaming DataFrame, except the cache, which needs
a batch at a time.  State is bounded by a watermark everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ticketloom.config import RISK_KEYWORDS, CacheSettings
from ticketloom.functions import text as X
from ticketloom.operators.cells import placed_in
from ticketloom.operators.hybrid import cache_admission, cache_lookup
from ticketloom.plans import scoring
from ticketloom.session import materialize
from ticketloom.sources.files import table_exists


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                files_per_batch: int = 1, names: str = "*") -> DataFrame:
    """Files of a folder, in order of arrival; ``names`` is a file name pattern."""
    reader = spark.readStream.schema(schema).format(fmt)
    return reader.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).load(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: StructType) -> DataFrame:
    """JSON messages of a topic; needs Spark's Kafka package on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available, write it as Parquet and read it back."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def score_stream(
    tickets: DataFrame, intents: DataFrame, classify: Callable, keywords
) -> DataFrame:
    """Stateless part of ticket scoring: intent, eligibility, keyword trigger."""
    from ticketloom.operators.intents import validate_intent, with_eligibility

    text = X.normalize_text("query")
    classified = tickets.withColumn("_raw", classify(text)).withColumn(
        "risk_keyword", X.keyword_first(text, keywords)
    )
    valid = validate_intent(classified, intents, "_raw").drop("_raw")
    named = with_eligibility(
        valid.withColumnRenamed("valid_intent", "predicted_intent"), intents, "predicted_intent"
    )
    return named.withColumn("should_escalate", ~F.col("eligible") | F.col("risk_keyword").isNotNull())


def _each_batch(stream: DataFrame, handle: Callable, checkpoint: str):
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def score_batches(
    stream: DataFrame, answers_path: str, checkpoint: str, index: dict, intents: DataFrame, lexicon: DataFrame,
    classify: Callable, keywords=RISK_KEYWORDS, **settings,
):
    """Score arriving tickets as the batch job does, one micro-batch at a time; returns the finished query.

    ``stream``: ``(ticket_id, brand, query, turn_count)``; ``index``: what ``load_index`` gives, its passages and its
    text index, of which nothing is built again.  Each batch owns the partition ``batch=<id>`` of the answers and
    overwrites it, so a replay changes nothing.  A batch without rows leaves none.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        tickets = materialize(batch, "arrived")
        scored = scoring.score_tickets(
            tickets, index["corpus"], intents, lexicon, classify, None, keywords, index=index["text"], **settings
        )
        scored.write.mode("overwrite").parquet(f"{answers_path}/batch={batch_id}")

    return _each_batch(stream, handle, checkpoint)


def open_cells(queries: DataFrame, centres: np.ndarray, radius: np.ndarray, least: float) -> list[int]:
    """Cells that may hold a vector with a cosine of at least ``least`` to one of the queries; at most one number a centre."""
    reach = math.acos(min(1.0, max(-1.0, least))) + 1e-6

    def run(batches):
        found = np.zeros(len(centres), bool)
        for b in batches:
            if b.num_rows:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                angle = np.arccos(np.clip(x / np.linalg.norm(x, axis=1)[:, None] @ centres.T, -1, 1))
                found |= (angle <= radius + reach).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32))], ["cell"])

    return sorted(r.cell for r in queries.select("vec").mapInArrow(run, "cell int").distinct().collect())


def cache_batches(
    stream: DataFrame, cache_path: str, answers_path: str, checkpoint: str,
    settings: CacheSettings = CacheSettings(), centres: np.ndarray | None = None,
):
    """Look up, then admit, one micro-batch at a time; returns the finished query.

    ``stream``: ``(q, vec, intent, draft_reply, confidence, should_escalate)``, unit-norm vectors.
    Rows of one batch do not see each other.  Each batch owns the partition
    ``batch=<id>`` of all tables and overwrites it, so a replay changes nothing.

    The cache is laid out by batch and by the cell of the nearest of the fixed ``centres`` (unit vectors; without
    them there is one cell).  A small table tells for each cell how many entries the batches so far left in it and how
    far they reach from the centre, so a batch reads only those partitions that its queries can reach, and counts nothing.
    """
    stats_path = f"{cache_path.rstrip('/')}-cells"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            own = np.array([batch.first().vec], np.float64) if centres is None and batch.first() else centres
            own = np.ones((1, 1)) if own is None else own / np.linalg.norm(own, axis=1)[:, None]
            n, radius = np.zeros(len(own), np.int64), np.full(len(own), -np.inf)
            if batch_id and table_exists(spark, f"{stats_path}/batch={batch_id - 1}"):
                for r in spark.read.parquet(f"{stats_path}/batch={batch_id - 1}").collect():  # one row a cell
                    n[r.cell], radius[r.cell] = r.n, r.radius
            cells = open_cells(batch, own, np.full(1, np.pi) if centres is None and n.any() else radius, settings.similarity_threshold)
            cells = [c for c in cells if n[c]]
            if cells:
                earlier = reachable(spark, cache_path, batch_id, cells)
                hits = cache_lookup(batch.select("q", "vec"), earlier, settings)
                answers = batch.select("q").join(hits.select("q", "cache_id"), "q", "left")
            else:
                answers = batch.select("q", F.lit(None).cast("bigint").alias("cache_id"))
            answers.write.mode("overwrite").parquet(f"{answers_path}/batch={batch_id}")
            served = spark.read.parquet(f"{answers_path}/batch={batch_id}").filter(F.col("cache_id").isNotNull())
            fresh = (
                batch.join(served.select("q"), "q", "left_anti")
                .withColumn("cached", F.lit(False))
                .withColumnRenamed("confidence", "classification_confidence")
            )
            admitted = cache_admission(fresh, "q", settings, int(n.sum()))
            rows = admitted.select(F.col("q").alias("id"), "vec", "intent", "draft_reply")
            placed = placed_in(rows, own).select("id", "cell", "angle")
            target = f"{cache_path}/batch={batch_id}"
            rows.join(placed, "id").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(target)
            added = spark.read.schema("cell int, angle double").parquet(target).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"))
            for r in added.collect():  # one row a cell
                n[r.cell], radius[r.cell] = n[r.cell] + r.n, max(radius[r.cell], r.r)
            state = [(int(c), int(n[c]), float(radius[c])) for c in np.flatnonzero(n)]
            spark.createDataFrame(state, "cell int, n long, radius double").coalesce(1).write.mode("overwrite").parquet(
                f"{stats_path}/batch={batch_id}"
            )
        finally:
            batch.unpersist()

    return _each_batch(stream, handle, checkpoint)


CACHED = "id long, vec array<float>, intent string, draft_reply string, angle double, batch long, cell int"


def reachable(spark: SparkSession, cache_path: str, batch_id: int, cells: list[int]) -> DataFrame:
    """Entries of earlier batches in some cells: a scan of these partitions only."""
    cached = spark.read.schema(CACHED).parquet(cache_path)
    return cached.filter((F.col("batch") < batch_id) & F.col("cell").isin(cells)).drop("batch", "cell", "angle")


def thread_join(replies: DataFrame, parents: DataFrame, horizon: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """A reply meets its customer message if it comes within the horizon.

    ``replies``: ``(reply_id, parent_ref, reply_ts, ...)``; ``parents``:
    ``(parent_id, parent_ts, ...)``.
    """
    r = replies.withWatermark("reply_ts", delay)
    p = parents.withWatermark("parent_ts", delay)
    in_reach = F.expr(
        "parent_ref = parent_id AND reply_ts >= parent_ts "
        f"AND reply_ts <= parent_ts + interval {horizon}"
    )
    return r.join(p, in_reach, "inner")


def dedup_replies(replies: DataFrame, key: str = "parent_ref", ts: str = "reply_ts", delay: str = "1 hour") -> DataFrame:
    """One reply per customer message within the watermark delay."""
    return replies.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def fragment_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """``(key, session_start, session_end, n)``; a stream emits closed sessions only."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    return (
        source.groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def volume(events: DataFrame, kind: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None,
           delay: str = "10 minutes") -> DataFrame:
    """Counts per kind in tumbling or sliding windows; late rows are dropped on a stream."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        source.groupBy(kind, window.alias("w"))
        .agg(F.count("*").alias("n"))
        .select(kind, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def turn_state(events: DataFrame, key: str, order: str, ts: str = "ts", max_turns: int = 3,
               delay: str = "10 minutes", idle_ms: int = 90 * 24 * 3600 * 1000) -> DataFrame:
    """Running turn count per key in order of event time, then of ``order`` (a long).

    A row waits in the key's state until the watermark has passed its time; then no earlier one can come, and
    what waits is numbered in order and given out.  So the result does not depend on how rows arrive
    within the delay, and a key's state is one counter and the rows of its last ``delay``.  Rows behind the watermark are late
    and dropped.  After a gap of more than ``idle_ms`` a key counts from one again, so its state can go by then.
    """
    kinds = dict(events.dtypes)

    def count(k: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, times, orders = state.get if state.exists else (0, 0, [], [])
        times, orders = [np.array(times, np.int64)], [np.array(orders, np.int64)]
        for piece in ([] if state.hasTimedOut else pieces):
            times.append(piece["_us"].to_numpy(np.int64))
            orders.append(piece[order].to_numpy(np.int64))
        at, number = np.concatenate(times), np.concatenate(orders)
        if state.hasTimedOut and not len(at):
            state.remove()
            return
        rank = np.lexsort((number, at))
        at, number = at[rank], number[rank]
        mark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(at, mark * 1000, side="right"))
        gap = np.diff(at[:ready], prepend=last) > idle_ms * 1000
        place = np.arange(ready)
        since = np.maximum.accumulate(np.where(gap, place, -seen)) if ready else place
        turns = place - since + 1
        yield pd.DataFrame({key: [k[0]] * ready, order: number[:ready], "turn_no": turns, "turn_trigger": turns >= max_turns})
        waiting = at[ready:]
        if ready:
            seen, last = int(turns[-1]), int(at[ready - 1])
        state.update((seen, last, waiting.tolist(), number[ready:].tolist()))
        # wakes up when the watermark has passed the first row that waits
        wake = int(waiting[0]) // 1000 - 1 if len(waiting) else last // 1000 + idle_ms
        state.setTimeoutTimestamp(max(wake, mark + 1))

    return (
        events.withWatermark(ts, delay)
        .withColumn("_us", F.unix_micros(ts))
        .groupBy(key)
        .applyInPandasWithState(
            count,
            f"{key} {kinds[key]}, {order} {kinds[order]}, turn_no bigint, turn_trigger boolean",
            "n bigint, last bigint, times array<bigint>, orders array<bigint>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
