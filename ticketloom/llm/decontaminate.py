"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.  A
window is ``window`` consecutive words of an item, or the whole of a shorter item.

1. Both sides hash all k-grams of words and keep the smallest hash of every run of
   ``window - k + 1`` k-grams.  Two texts that share a window share a kept hash at the
   same place in it, so no shared window is missed.
2. Kept hashes of documents meet those of the benchmark.  The benchmark's are written
   and Spark broadcasts them only below its size threshold.
3. Hits are extended: every window around a met place is compared with the
   items' windows as words, so a document's answer never rests on a hash.

Shorter items have their own k and run for each length below ``window``.

Null and empty texts have no words.  Items of equal words are compared once.  Repeated documents give
repeated rows; repeated items are one item; texts under one item_id are one item;
a null item_id is listed as the empty string.  An empty benchmark hits nothing.
An empty table of documents gives no rows; other columns are kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ticketloom.llm.common import materialize, whole_row

WINDOW = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE = 31  # low bits of a kept hash: the place of its k-gram


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is the fast way where all is ASCII, and would change other letters where not
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def scheme(length: int) -> tuple[int, int]:
    """k and the number of k-grams of which one is kept, for windows of a length."""
    k = min(GRAM, length)
    return k, length - k + 1


def _front(values: str, n: int) -> Column:
    """All but the last n elements."""
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - n, F.lit(0)))


def _with(values: str, n: int, join):
    """``join`` of each element with the n that follow it."""
    return F.transform(
        _front(values, n), lambda x, i: join(x, *[F.get(F.col(values), i + j) for j in range(1, n + 1)], place=i)
    )


def winnowed(rows: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Add ``f<length>`` for each length: kept hashes as ``hash << 31 | place``.

    Steps are columns of their own, so that no array is computed more than once.
    """
    def gram(*h, place):
        return F.shiftleft(F.hash(*h).cast("long"), _PLACE) + place

    def least(*g, place):
        return F.least(*g) if len(g) > 1 else g[0]

    own = rows.columns
    out = rows.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    grams = {scheme(n)[0] for n in lengths}
    out = out.select("*", *[_with("_h", k - 1, gram).alias(f"_g{k}") for k in grams])
    out = out.select("*", *[_with(f"_g{k}", w - 1, least).alias(f"_m{n}") for n in lengths for k, w in [scheme(n)]])
    return out.select(*own, *[F.array_distinct(f"_m{n}").alias(f"f{n}") for n in lengths])


class Benchmark:
    """Windows and kept hashes of the benchmark's items, written once."""

    def __init__(self, items: DataFrame, window: int = WINDOW):
        named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
        named = named.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
        # items of the same words: the smallest id stands for them until the end
        same = W.partitionBy("words")
        self.members = materialize(named.select(F.min("item").over(same).alias("cls"), "item", "words", "length").distinct(), "items")
        own = self.members.filter("item = cls").drop("item")
        # at most ``window`` numbers
        self.lengths = sorted(r.length for r in own.select("length").distinct().collect())
        starts = F.sequence(F.lit(0), F.size("words") - F.col("length"))
        gram = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, F.col("length")), " "))
        self.windows = materialize(own.select("cls", "length", F.explode(gram).alias("gram")).distinct(), "windows")
        # (explode_outer: Spark copies what explode takes into a filter below it, and would compute these arrays many times)
        kept = winnowed(own.select("words", "length"), "words", self.lengths) if self.lengths else None
        parts = [
            kept.filter(F.col("length") == n).select(F.lit(n).alias("length"), F.explode_outer(f"f{n}").alias("v")) for n in self.lengths
        ]
        self.kept = (
            materialize(
                reduce(DataFrame.union, parts).filter("v is not null").select("length", F.shiftright("v", _PLACE).cast("int").alias("hash")).distinct(), "kept"
            )
            if parts
            else None
        )


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias("k")


class Decontamination:
    """``report`` and ``hits`` of documents against a benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        bench = Benchmark(items, window)
        self.docs = docs
        own = docs.select(_key(), words_of(F.col("text")).alias("words"))
        # (explode_outer: Spark copies what explode takes into a filter below it, and would compute these arrays many times)
        kept = winnowed(own, "words", bench.lengths)
        #: One row per document: its number of words and kept hashes.
        self.marked = materialize(
            kept.select("k", F.size("words").cast("long").alias("n_words"), *[f"f{n}" for n in bench.lengths]), "winnowed"
        )
        if not bench.lengths:
            self.hits = docs.sparkSession.createDataFrame([], f"k {self.marked.schema['k'].dataType.simpleString()}, start int, length int, cls string")
            self.members = bench.members
            return
        met = []
        for n in bench.lengths:
            place = F.col("v").bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int").alias("place")
            rows = self.marked.select("k", F.explode(f"f{n}").alias("v"))
            rows = rows.select("k", place, F.shiftright("v", _PLACE).cast("int").alias("hash"))
            other = bench.kept.filter(F.col("length") == n).select("hash")
            met.append(rows.join(other, "hash").select("k", F.lit(n).alias("length"), "place"))
        anchors = reduce(DataFrame.union, met).groupBy("k").agg(F.collect_set(F.struct("length", "place")).alias("met"))
        anchors = materialize(anchors, "anchors")
        near = (
            docs.select(_key(), words_of(F.col("text")).alias("words"))
            .join(anchors, "k")
            .withColumn("n", F.size("words"))
            .withColumn("starts", F.array_distinct(F.flatten(F.transform("met", _starts))))
            .withColumn(
                "grams",
                F.transform(
                    "starts",
                    lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"),
                                       F.array_join(F.slice("words", s["start"] + 1, s["length"]), " ").alias("gram")),
                ),
            )
            .select("k", F.inline_outer("grams"))
        )
        #: One row per window of a document that an item has: ``k, start, length, cls``.
        self.hits = materialize(near.join(bench.windows, ["length", "gram"]).select("k", "start", "length", "cls").distinct(), "hits")
        self.members = bench.members

    def report(self) -> DataFrame:
        """``doc_id, n_words, n_hit, n_items, items, contaminated``, one row per row of the documents."""
        upto = W.partitionBy("k").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
        stop = F.col("start") + F.col("length")
        # what a window adds to the words that earlier ones cover
        added = self.hits.select("k", "start", "length").distinct().select(
            "k", F.greatest(stop - F.greatest("start", F.coalesce(F.max(stop).over(upto), F.lit(0))), F.lit(0)).alias("added")
        )
        n_hit = added.groupBy("k").agg(F.sum("added").cast("long").alias("n_hit"))
        items = (
            self.hits.select("k", "cls").distinct().join(self.members.select("cls", "item").distinct(), "cls")
            .groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))
        )
        none = F.array().cast("array<string>")
        return (
            self.marked.select("k", "n_words")
            .join(n_hit.join(items, "k"), "k", "left")
            .select(
                F.col("k.d").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
                (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            )
        )

    def clean(self) -> DataFrame:
        """The documents without a hit, with all their columns."""
        hit = self.hits.select("k").distinct()
        rows = self.docs.select(_key(), whole_row(self.docs).alias("_row"))
        return rows.join(hit, "k", "left_anti").select("_row.*")


def _starts(met: Column) -> Column:
    """Starts of the windows of a document that hold a met k-gram."""
    back = met["length"] - F.least(met["length"], F.lit(GRAM))
    first, last = F.greatest(met["place"] - back, F.lit(0)), F.least(met["place"], F.col("n") - met["length"])
    return F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), met["length"].alias("length")))
