"""Mixing sources to target weights, by blocks of words.

1. Words of a source form one stream, in an order drawn by hash; every document
   has a place in it.  Streams are cut into blocks of equal length, give or take a
   word: at most ``block_words`` words, and less where a source or its target is small.
2. Slots of a source over all shards are its target in blocks of its own length, so the
   mix has as many slots as these sum to.  They are dealt over shards; the counts of a shard are
   drawn by multinomial splits from the whole down to the shard, each taken from
   what is left, so the sums meet the targets.  A shard draws its own path only.
3. The j-th slot of a source takes block ``j mod n`` in a pseudorandom permutation
   of the source's n blocks, a new one for each round of n; so no block is taken
   more than once a round, and rounds end at ``max_repeats``.
4. Slots meet blocks in a join on (source, block).

Null text has size 0, and documents of size 0 are in no block.  Null is a source
of its own, last in order.  Repeated rows are documents of their own.  Seeds are
parameters: a rerun gives the same mix.  The number of sources is that of a
mixing recipe and fits the driver; nothing that grows with the documents does.
An empty table gives no rows; other columns are kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.llm.common import left_by_key, materialize, running_offsets, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
MAX_REPEATS = 3
LEAST_BLOCKS = 16  # in a source and in its target, as far as there are words; the target is met within one and a half blocks
FINEST = 1 << 20  # blocks a source is cut into for the sake of a small target
SEED = 20240607


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, th, size`` of every row."""
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", F.xxhash64("text").alias("th"), n.cast("long").alias("size"))


def targets(source_sizes: Sequence[int], weights: Sequence[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Share the total by weight; what passes ``max_repeats`` times a size is shared anew among the rest."""
    total, out, open_ = float(sum(source_sizes)), [0.0] * len(source_sizes), set(range(len(source_sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(out)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > max_repeats * source_sizes[i]}
        for i in over or open_:
            out[i] = float(max_repeats * source_sizes[i]) if over else left * weights[i] / weight
        open_ = open_ - over if over else set()
    return out


def cut_blocks(size: int, target: float, block_words: int = BLOCK_WORDS) -> int:
    """Number of equal blocks of a source; even small sources and targets are several blocks."""
    if not size or not target:
        return -(-size // block_words)
    length = max(1, min(block_words, int(min(size, target) / LEAST_BLOCKS)))
    return max(-(-size // block_words), min(-(-size // length), FINEST))


def whole_slots(size: int, target: float, blocks: int, max_repeats: int = MAX_REPEATS) -> int:
    """Slots that hold the target, at the mean length of the source's blocks."""
    return min(round(target * blocks / size), max_repeats * blocks) if size else 0


def _split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial draw of n of the counted slots, never more of a source than are left."""
    taken = np.zeros_like(counts)
    while (need := n - int(taken.sum())) > 0:
        left = counts - taken
        p = left / left.sum()
        taken += np.minimum(rng.multinomial(need, p / p.sum()), left)
    return taken


def shard_counts(shard: int, shards: int, counts: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it."""
    lo, hi, before, counts = 0, shards, np.zeros_like(counts), counts.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _split(counts, min((mid - lo) * slots, int(counts.sum())), rng)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, before, counts = mid, before + left, counts - left
    return counts, before


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0..n-1 sends each j (Feistel rounds, walked into range)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(j, np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            f = (b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r) * 0xD1B54A32D192ED03 % 2**64)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def placed(sized: DataFrame) -> DataFrame:
    """Add ``first``: words of the source before this document.

    A source's documents are dealt into buckets by hash; only sums of buckets are
    put in order over the whole source, so no task holds a large source.
    """
    buckets = 1024
    d = sized.filter("size > 0").withColumn("b", F.pmod(F.xxhash64(F.col("doc_id"), F.col("th")), F.lit(buckets)))
    totals = running_offsets(d.groupBy("source", "b").agg(F.sum("size").alias("n")), ["source"], "b", "n", "offset")
    within = W.partitionBy("source", "b").orderBy("doc_id", "th", "size").rowsBetween(W.unboundedPreceding, -1)
    own = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return left_by_key(own, totals.drop("n"), "source", "b").withColumn("first", F.col("offset") + F.col("inside")).drop(
        "b", "offset", "inside"
    )


class Mix:
    """The plan of a mix: ``documents`` (sizes, targets, places) and ``slots`` (shard, slot, source, block)."""

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = WEIGHTS,
        block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS,
        max_repeats: int = MAX_REPEATS,
        seed: int = SEED,
    ):
        spark = docs.sparkSession
        sized = materialize(sizes(docs), "mix-sizes")
        # one row per source: the recipe
        recipe = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
        recipe.sort(key=lambda r: (r.source is None, r.source or ""))  # Python orders text by code points
        w = [weights[i % len(weights)] for i in range(len(recipe))]
        n = [int(r.n or 0) for r in recipe]
        aim = targets(n, w, max_repeats)
        blocks = [cut_blocks(x, a, block_words) for x, a in zip(n, aim)]
        slots = np.array([whole_slots(x, a, b, max_repeats) for x, a, b in zip(n, aim, blocks)], np.int64)
        rows = [(i, r.source, n[i], aim[i], blocks[i], int(slots[i])) for i, r in enumerate(recipe)]
        self.sources = spark.createDataFrame(
            rows, "sid int, source string, source_size long, target double, n_blocks long, n_slots long"
        )
        self.documents = left_by_key(sized, F.broadcast(self.sources), "source")
        total = int(slots.sum())
        shards = max(1, -(-total // shard_slots))

        def draw(batches):
            for b in batches:
                for shard in b["id"]:
                    counts, before = shard_counts(int(shard), shards, slots, shard_slots, seed)
                    out = []
                    for i in np.flatnonzero(counts):
                        j = np.arange(before[i], before[i] + counts[i])
                        turn, at = j // blocks[i], j % blocks[i]
                        block = np.empty_like(j)
                        for t in np.unique(turn):
                            block[turn == t] = permuted(at[turn == t], blocks[i], seed + 7919 * int(i) + int(t))
                        out.append(pd.DataFrame({"sid": np.int32(i), "block": block, "turn": turn}))
                    if out:
                        d = pd.concat(out)
                        order = np.random.default_rng([seed, int(shard), 1]).permutation(len(d))
                        yield d.assign(shard=int(shard), slot=order)[["shard", "slot", "sid", "block", "turn"]]

        parts = max(1, min(shards, 10_000))
        drawn = spark.range(0, shards, 1, parts).mapInPandas(draw, "shard long, slot long, sid int, block long, turn long")
        # written, as Spark would guess its size from the number of shards and broadcast it
        self.slots = materialize(drawn, "mix-slots")

    def pieces(self) -> DataFrame:
        """``sid, block, doc_id, th, from_word, n_words``: the words of documents that make up each block."""
        placed_ = placed(self.documents.select("doc_id", "th", "source", "sid", "size"))
        # the first ``longer`` blocks of a source have ``short`` + 1 words, the others ``short``
        cut = self.sources.filter("n_blocks > 0").select(
            "sid", F.expr("source_size div n_blocks").alias("short"), (F.col("source_size") % F.col("n_blocks")).alias("longer")
        )
        own = placed_.join(F.broadcast(cut), "sid")
        at = "if({0} < longer * (short + 1), {0} div (short + 1), longer + ({0} - longer * (short + 1)) div short)"
        blocks = F.sequence(F.expr(at.format("first")), F.expr(at.format("(first + size - 1)")))
        spread = own.withColumn("block", F.explode(blocks))
        opens = F.col("block") * F.col("short") + F.least("block", "longer")
        closes = opens + F.col("short") + (F.col("block") < F.col("longer")).cast("long")
        start = F.greatest(opens, F.col("first"))
        stop = F.least(closes, F.col("first") + F.col("size"))
        return spread.select(
            "sid", "block", "doc_id", "th", "size", (start - F.col("first")).alias("from_word"), (stop - start).alias("n_words")
        )

    def taken_pieces(self) -> DataFrame:
        """``pieces`` with ``copies``, how often the mix takes the block; blocks it leaves out are absent."""
        copies = self.slots.groupBy("sid", "block").agg(F.count("*").alias("copies"))
        return self.pieces().join(copies, ["sid", "block"])

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``, one row per row of the documents.

        Rows with one id and text have one sum; each of them gets its equal part.
        """
        per = (
            self.taken_pieces()
            .groupBy("doc_id", "th", "sid")
            .agg(F.sum(F.col("n_words") * F.col("copies")).alias("sum"))
        )
        # repeated rows: the sum over all of them is dealt evenly, the first ones take the rest
        twins = W.partitionBy("doc_id", "th", "sid").orderBy(F.lit(0))
        rows = self.documents.withColumn("k", F.row_number().over(twins)).withColumn(
            "twins", F.count("*").over(W.partitionBy("doc_id", "th", "sid"))
        )
        joined = left_by_key(rows, per, "doc_id", "th", "sid")
        total = F.coalesce("sum", F.lit(0))
        share = F.floor(total / F.col("twins")) + F.when(F.col("k") <= total % F.col("twins"), 1).otherwise(0)
        return joined.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """``shard, slot, source, text``: the mixed blocks, their words joined by spaces.

        Words are cut from the document in the join's row; the blocks, not the texts, are shuffled after it.
        """
        cut = keyed_pieces(self, docs).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "words"))).alias("w"))
        block = cut.select("sid", "block", F.array_join(F.transform("w", lambda s: s["words"]), " ").alias("text"))
        named = self.slots.join(F.broadcast(self.sources.select("sid", "source")), "sid")
        return named.join(block, ["sid", "block"]).select("shard", "slot", "source", "text")


def word_list(column: str = "text"):
    """The words of a text, as :func:`sizes` counts them."""
    return F.filter(F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def keyed_pieces(mix: Mix, docs: DataFrame) -> DataFrame:
    """Pieces of the blocks with their words."""
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), word_list().alias("all")).dropDuplicates(["doc_id", "th"])
    joined = left_by_key(mix.pieces().withColumn("at", F.col("from_word")), words, "doc_id", "th")
    piece = F.slice("all", F.col("from_word").cast("int") + 1, F.col("n_words").cast("int"))
    return joined.select("sid", "block", "at", "doc_id", F.array_join(piece, " ").alias("words"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each document and round, with the words that the round takes.

    Keeps the columns of ``docs``; ``text`` is the taken words in their order with the white space between them as it
    was, a line break between words from apart, or the text itself where the round takes all of it.  Documents of which nothing is taken are left out; of rows
    repeated with one id and text, one stands for all, with the words that the mix takes of any of them.
    """
    mix = Mix(docs, **options)
    rounds = mix.slots.select("sid", "block", "turn")
    per = (
        mix.pieces()
        .join(rounds, ["sid", "block"])
        .groupBy("doc_id", "th", "sid", "turn")
        .agg(
            F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("cuts"),
            F.sum("n_words").alias("taken"),
            F.max("size").alias("size"),
        )
    )
    own = docs.select(
        F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), whole_row(docs).alias("_row")
    ).dropDuplicates(["_d", "_t"])
    words = F.col("_row.text")
    joined = per.join(own, F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_t").eqNullSafe(F.col("th"))).withColumn(
        "_all", F.regexp_extract_all(F.col("_row.text").cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    )

    def piece(c, i):
        words = F.array_join(F.slice("_all", c["from_word"].cast("int") + 1, c["n_words"].cast("int")), "")
        last = F.get("cuts", i - 1)
        follows = (i > 0) & (last["from_word"] + last["n_words"] == c["from_word"])
        bare = F.regexp_replace(words, r"^[\x20\x09-\x0D]+", "")
        return F.when(follows, words).otherwise(F.concat(F.when(i > 0, "\n").otherwise(""), bare))

    cut = F.array_join(F.transform("cuts", piece), "")
    text = F.when(F.col("taken") == F.col("size"), words).otherwise(cut)
    changed = {"text": text, "n_chars": F.length(text)}
    kinds = dict(docs.dtypes)
    return joined.select(
        *[(changed[c].cast(kinds[c]) if c in changed else F.col(f"_row.`{c.replace('`', '``')}`")).alias(c) for c in docs.columns]
    )
