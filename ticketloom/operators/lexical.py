"""Sparse text retrieval as joins: postings, BM25, tf-idf and exact top-k.

A text collection is a DataFrame ``(grp, doc, text)``; ``grp`` keeps separate
collections (brands) apart in one job.  Exact copies are folded into one
representative before anything is scored and unfolded after ranking, so a
large group of copies costs one scored row.

``sparse_topk`` knows from the term statistics how many rows a plain join of
query terms and postings would give, and takes that join only up to a fixed
budget.  Beyond it, blocks of queries meet blocks of documents, and a task adds
up the scores of its pairs in arrays and gives the best few of each query.  Both
ways are exact.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ticketloom.config import STOP_WORDS
from ticketloom.functions import text as X
from ticketloom.operators.dense import best_of
from ticketloom.session import materialize

_DIRECT_ROWS = 2_000_000  # largest query-term/posting join taken without blocks
_PART_BYTES = 4 << 20  # of text whose terms a task counts
_COUNTED = 1_000_000  # terms, beside one row's, that a task counts at a time
SENT_TERMS = 1_000_000  # largest vocabulary that goes to every task
_BLOCK_ROWS = 2_000_000  # query terms or postings in a block
_TASK_WORK = 250_000_000  # products of a task, where smaller blocks than memory asks give more tasks
_TASKS = 64  # of a collection, as long as blocks stay below their size
_MOST_PARTITIONS = 10_000
_CELLS = 1 << 22  # scores that a task holds at a time
_COMMON = 12  # a term of more than one in so many documents takes part in a dense product
_TIE = 9  # scores equal to this many decimals are ties, resolved by id


@dataclass(frozen=True)
class Bm25:
    """Okapi parameters; a negative idf becomes ``epsilon`` times the mean idf."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class TfIdf:
    max_features: int | None = None  # the commonest terms only; retrieval uses all
    min_df: int = 1
    ngrams: int = 1
    stop_words: Sequence[str] = STOP_WORDS


class TextIndex:
    """The tables that the searches below read, each written once, when it is first needed or stored.

    ``reps`` (grp, doc, n_copies, text) and ``members`` (grp, doc, member) are the distinct texts and the members
    of each that a top k can need; the rest follows from them and the parameters.  The index knows its k and its
    parameters: a search for more results, or a load with other parameters, is an error.
    """

    PARTS = ("reps", "members", "postings", "terms", "vocabulary", "vectors", "bounds")

    def __init__(self, reps: DataFrame, members: DataFrame, k: int, bm25: Bm25 = Bm25(), tfidf: TfIdf = TfIdf()):
        self.reps, self.members, self.k, self.bm25, self.tfidf = reps, members, k, bm25, tfidf

    @property
    def _settings(self) -> str:
        return json.dumps([asdict(self.bm25), asdict(self.tfidf) | {"stop_words": list(self.tfidf.stop_words)}])

    def serves(self, k: int) -> None:
        if k > self.k:
            raise ValueError(f"the index holds the members of a text that {self.k} results can need, not {k}")

    @cached_property
    def _sizes(self) -> DataFrame:
        return materialize(bm25_collection_stats(self.reps), "sizes")

    @cached_property
    def postings(self) -> DataFrame:
        """``(grp, term, doc, n_copies, tf, w)`` of BM25."""
        return materialize(bm25_postings(self.reps, self._sizes, self.bm25), "postings")

    @cached_property
    def terms(self) -> DataFrame:
        """``(grp, term, n_posts, df, total_tf, max_w, idf)`` of BM25."""
        return materialize(bm25_term_stats(self.postings, self._sizes, self.bm25), "terms")

    @cached_property
    def vocabulary(self) -> DataFrame:
        """``(term, df, total_tf, idf)`` of tf-idf."""
        return materialize(tfidf_vocabulary(self.reps, self.tfidf), "vocabulary")

    @cached_property
    def vectors(self) -> DataFrame:
        """``(grp, doc, term, w)`` of tf-idf."""
        return materialize(tfidf_vectors(self.reps, self.vocabulary, self.tfidf), "vectors")

    @cached_property
    def bounds(self) -> DataFrame:
        """``(grp, term, n_posts, max_w)`` of tf-idf."""
        stats = self.vectors.groupBy("grp", "term").agg(F.count("*").alias("n_posts"), F.max("w").alias("max_w"))
        return materialize(stats, "bounds")

    def store(self, path: str, mode: str = "error") -> None:
        """Write all tables; those that are looked up by term are ordered by it inside their files."""
        for part in self.PARTS:
            table = getattr(self, part)
            if "term" in table.columns:
                table = table.repartitionByRange("term").sortWithinPartitions("term")
            table.write.mode(mode).parquet(f"{path}/{part}")
        meta = self.reps.sparkSession.createDataFrame([(self.k, self._settings)], "k int, settings string")
        meta.coalesce(1).write.mode(mode).parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, bm25: Bm25 = Bm25(), tfidf: TfIdf = TfIdf()) -> "TextIndex":
        """A stored index; nothing of it is built again.  The parameters must be those it was built with."""
        tables = {part: spark.read.parquet(f"{path}/{part}") for part in cls.PARTS}
        meta = spark.read.parquet(f"{path}/meta").first()
        index = cls(tables.pop("reps"), tables.pop("members"), meta.k, bm25, tfidf)
        if meta.settings != index._settings:
            raise ValueError(f"the index was built with {meta.settings}")
        index.__dict__.update(tables)
        return index


def as_collection(
    df: DataFrame, id_col: str, text_col: str, grp_col: str | None = None
) -> DataFrame:
    """Shape a table as ``(grp, doc, text)`` with lower-cased, normalised text."""
    grp = F.col(grp_col) if grp_col else F.lit("")
    return df.select(
        grp.alias("grp"),
        F.col(id_col).alias("doc"),
        F.lower(X.normalize_text(text_col)).alias("text"),
    )


def fold_copies(docs: DataFrame) -> DataFrame:
    """``(grp, doc, n_copies, text)``: one row per distinct text, named by its lowest id."""
    return docs.groupBy("grp", "text").agg(
        F.min("doc").alias("doc"), F.count("*").alias("n_copies")
    )


def lowest_members(docs: DataFrame, k: int) -> DataFrame:
    """``(grp, doc, member)``: the k lowest ids of each distinct text.

    The rank filter runs before the shuffle too, so of a large group of copies
    each task sends k rows.
    """
    keyed = docs.select("grp", F.col("doc").alias("member"), F.sha2("text", 256).alias("digest"))
    w = W.partitionBy("grp", "digest").orderBy("member")
    lowest = keyed.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k)
    return lowest.select("grp", F.first("member").over(w).alias("doc"), "member")


def build_index(corpus: DataFrame, k: int, bm25: Bm25 = Bm25(), tfidf: TfIdf = TfIdf()) -> TextIndex:
    """Index a ``(grp, doc, text)`` collection for searches of up to k results."""
    docs = materialize(corpus, "texts")
    return TextIndex(
        materialize(fold_copies(docs), "reps"), materialize(lowest_members(docs, k), "members"), k, bm25, tfidf
    )


# ---------------------------------------------------------------- BM25


def text_parts(texts: DataFrame) -> int:
    """Partitions of a bounded size of text, whatever the input: terms are counted in memory."""
    return int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _PART_BYTES) + 1


def bm25_counts(reps: DataFrame) -> DataFrame:
    """``(grp, doc, n_copies, dl, term, tf)`` with whitespace tokens.

    Texts are spread by document before they are cut into tokens, so the counts
    need no second, much larger shuffle of tokens.
    """
    tokens = reps.repartition(text_parts(reps), "doc").select(
        "grp", "doc", "n_copies", X.space_tokens("text").alias("tokens")
    )
    return (
        X.each(tokens, F.col("tokens"), "term", "grp", "doc", "n_copies", F.size("tokens").alias("dl"))
        .groupBy("grp", "doc", "n_copies", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def bm25_collection_stats(reps: DataFrame) -> DataFrame:
    """One row per collection: document count and mean length, empty texts included."""
    return (
        reps.select("grp", "n_copies", F.size(X.space_tokens("text")).alias("dl"))
        .groupBy("grp")
        .agg(
            F.sum("n_copies").alias("n_docs"),
            (F.sum(F.col("dl") * F.col("n_copies")) / F.sum("n_copies")).alias("avgdl"),
        )
    )


def bm25_postings(reps: DataFrame, sizes: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """``(grp, term, doc, n_copies, tf, w)``: the part of the score that ignores idf.

    ``sizes`` has one row per collection (brand); pass it as a written table, so
    that its true size makes the join a broadcast.
    """
    length_norm = 1 - params.b + params.b * F.col("dl") / F.col("avgdl")
    weight = F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * length_norm)
    return bm25_counts(reps).join(sizes.select("grp", "avgdl"), "grp").select(
        "grp", "term", "doc", "n_copies", "tf", weight.alias("w")
    )


def bm25_term_stats(postings: DataFrame, sizes: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """``(grp, term, n_posts, df, total_tf, max_w, idf)`` with the idf floor applied."""
    raw = materialize(
        postings.groupBy("grp", "term")
        .agg(
            F.count("*").alias("n_posts"),
            F.sum("n_copies").alias("df"),
            F.sum(F.col("tf") * F.col("n_copies")).alias("total_tf"),
            F.max("w").alias("max_w"),
        )
        .join(sizes.select("grp", "n_docs"), "grp")
        .withColumn(
            "raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        ),
        "term-stats",
    )
    # one row per collection
    mean = materialize(raw.groupBy("grp").agg(F.avg("raw_idf").alias("mean_idf")), "mean-idf")
    idf = F.when(F.col("raw_idf") < 0, params.epsilon * F.col("mean_idf")).otherwise(
        F.col("raw_idf")
    )
    return raw.join(mean, "grp").select(
        "grp", "term", "n_posts", "df", "total_tf", "max_w", idf.alias("idf")
    )


def query_term_counts(queries: DataFrame) -> DataFrame:
    """``(grp, q, term, qtf)``; a repeated query token counts again."""
    return (
        X.each(queries, X.space_tokens("text"), "term", "grp", F.col("doc").alias("q"))
        .groupBy("grp", "q", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_search(queries: DataFrame, index: TextIndex, k: int = 15) -> DataFrame:
    """Best k documents per query with a positive score: ``(grp, q, doc, score, rank)``."""
    index.serves(k)
    weighted = (
        materialize(query_term_counts(queries), "asked")
        .join(index.terms, ["grp", "term"])
        .select(
            "grp", "q", "term", (F.col("qtf") * F.col("idf")).alias("qw"), "n_posts", "max_w"
        )
    )
    best = sparse_topk(weighted, index.postings.select("grp", "term", "doc", "w"), k)
    return unfold_copies(best, index.members, k).filter(F.col("score") > 0)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 15, params: Bm25 = Bm25()) -> DataFrame:
    return bm25_search(queries, build_index(corpus, k, params), k)


# -------------------------------------------------------------- tf-idf


def with_terms(df: DataFrame, params: TfIdf) -> DataFrame:
    """Add ``terms``; n-grams are formed after the stop words are gone."""
    stop = list(params.stop_words)
    found = X.words("text")
    out = df.withColumn("terms", F.filter(found, lambda t: ~t.isin(stop)) if stop else found)
    if params.ngrams >= 2:
        # zip the term list with shifted copies of itself
        grams = [F.col("terms")]
        for n in range(2, params.ngrams + 1):
            gram = F.col("terms")
            for shift in range(1, n):
                gram = F.zip_with(
                    gram,
                    F.slice("terms", shift + 1, F.greatest(F.size("terms"), F.lit(1))),
                    lambda a, b: F.concat(a, F.lit(" "), b),
                )
            grams.append(F.filter(gram, lambda g: g.isNotNull()))
        out = out.withColumn("terms", F.concat(*grams))
    return out


def tfidf_vocabulary(reps: DataFrame, params: TfIdf = TfIdf()) -> DataFrame:
    """``(term, df, total_tf, idf)``; only the ``max_features`` commonest terms if a number is given."""
    # A task counts a bounded number of terms at a time where the texts lie; the counts meet in partitions of as
    # many terms as the text gives.
    parts = text_parts(reps)
    rows = with_terms(reps.select("text", F.col("n_copies").cast("bigint").alias("n")), params).select("terms", "n")
    by_chunk = rows.mapInArrow(_count_terms, "term string, tf long, df long")
    n_docs = reps.agg(F.sum("n_copies").alias("n")).scalar()
    kept = (
        by_chunk.repartition(parts, "term")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("tf").alias("total_tf"))
        .filter(F.col("df") >= params.min_df)
    )
    if params.max_features is not None:
        kept = kept.orderBy(F.desc("total_tf"), "term").limit(params.max_features)
    return kept.withColumn("idf", F.log((n_docs + 1) / (F.col("df") + 1)) + 1)


def _count_terms(batches):
    """``term, tf, df`` of some rows at a time: occurrences, and rows with the term, each as often as the row has copies."""
    for b in batches:
        lists, n = b.column("terms"), b.column("n").to_numpy()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        chunk = np.cumsum(lengths, dtype=np.int64) // _COUNTED
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
            values = lists.slice(low, high - low).flatten()
            row = np.repeat(np.arange(low, high), lengths[low:high])
            if values.null_count:
                row, values = row[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
            if not len(values):
                continue
            coded = values.dictionary_encode()
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            seen = np.unique(row * size + code)
            tf, df = np.zeros((2, size), np.int64)
            np.add.at(tf, code, n[row])
            np.add.at(df, seen % size, n[seen // size])
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(tf), pa.array(df)], ["term", "tf", "df"])


def tfidf_vectors(
    texts: DataFrame, vocabulary: DataFrame, params: TfIdf = TfIdf()
) -> DataFrame:
    """Unit-norm sparse vectors ``(grp, doc, term, w)``.

    Pass a written vocabulary: it is read twice, and its size decides whether it goes to every task.
    """
    parts = text_parts(texts)
    occurring = X.each(with_terms(texts.repartition(parts, "doc"), params), F.col("terms"), "term", "grp", "doc")
    kept, capped = vocabulary.select("term", "idf"), params.max_features is not None
    if capped:  # most terms go before they are counted
        occurring = occurring.join(F.broadcast(kept.select("term")), "term", "left_semi")
    hits = occurring.groupBy("grp", "doc", "term").agg(F.count("*").alias("tf"))
    if capped or kept.count() <= SENT_TERMS:
        hits = hits.join(F.broadcast(kept), "term")
    else:
        hits = hits.repartition(parts, "term").join(kept, "term").repartition(parts, "doc")
    raw = hits.select("grp", "doc", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("grp", "doc")))
    return raw.select("grp", "doc", "term", (F.col("raw") / norm).alias("w"))


def cosine_search(queries: DataFrame, index: TextIndex, k: int = 15) -> DataFrame:
    """Nearest k documents per query by tf-idf cosine: ``(grp, q, doc, score, rank)``."""
    index.serves(k)
    asked = tfidf_vectors(queries, index.vocabulary, index.tfidf).select(
        "grp", F.col("doc").alias("q"), "term", F.col("w").alias("qw")
    )
    weighted = (
        materialize(asked, "asked")
        .join(index.bounds, ["grp", "term"])
    )
    return unfold_copies(sparse_topk(weighted, index.vectors, k), index.members, k)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 15, params: TfIdf = TfIdf()) -> DataFrame:
    return cosine_search(queries, build_index(corpus, k, tfidf=params), k)


# --------------------------------------------------------- exact top-k


def sparse_topk(
    weighted: DataFrame, postings: DataFrame, k: int, direct_rows: int = _DIRECT_ROWS
) -> DataFrame:
    """Exact top k of ``sum(qw * w)`` over shared terms.

    ``weighted``: ``(grp, q, term, qw, n_posts, max_w)``; ``postings``:
    ``(grp, term, doc, w)`` with ``w >= 0``.  The query terms are written down:
    they are read more than once, and their true size decides whether the next
    join broadcasts.
    """
    terms = materialize(weighted.select("grp", "q", "term", "qw", "n_posts"), "terms")
    size = terms.agg(F.sum("n_posts").alias("n")).first()["n"] or 0
    if size <= direct_rows:
        scored = (
            terms.join(postings, ["grp", "term"])
            .groupBy("grp", "q", "doc")
            .agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
        )
        return rank_topk(scored, k)
    return rank_topk(_block_scores(terms, postings, k), k)


def _block_scores(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``(grp, q, doc, score)`` with the best k documents of each query and block of documents.

    A collection's queries and documents are dealt by hash into blocks of bounded size, of which each two meet in a
    task, so a pair of query and document is a number in an array there and never a row.  Blocks are smaller
    than memory asks where that gives more tasks, up to a fixed number of tasks a collection, so that rows are repeated for
    a few blocks at any size.
    """
    numbered = materialize(
        terms.groupBy("grp", "term")
        .agg(F.count("*").alias("n_asked"), F.max("n_posts").alias("n_posts"))
        .withColumn("t", F.monotonically_increasing_id()),
        "numbered",
    )
    work = F.sum(F.col("n_asked") * F.col("n_posts"))
    sizes = numbered.groupBy("grp").agg(F.sum("n_asked").alias("n_asked"), F.sum("n_posts").alias("n_posts"), work.alias("work"))
    tasks = F.least(F.ceil(F.col("work") / _TASK_WORK), F.lit(_TASKS))
    even = F.ceil(F.sqrt(F.col("tasks") * F.col("n_posts") / F.col("n_asked")))
    doc_parts = F.greatest(F.ceil(F.col("n_posts") / _BLOCK_ROWS), F.least("tasks", even))
    query_parts = F.greatest(F.ceil(F.col("n_asked") / _BLOCK_ROWS), F.ceil(F.col("tasks") / F.col("doc_parts")))
    blocks = sizes.withColumn("tasks", tasks).withColumn("doc_parts", doc_parts.cast("int")).withColumn("query_parts", query_parts.cast("int"))
    blocks = materialize(blocks.select("grp", "doc_parts", "query_parts"), "blocks")  # one row per collection
    total = blocks.agg(F.sum(F.col("doc_parts") * F.col("query_parts"))).first()[0] or 1
    # Both tables are written, so their true sizes decide: postings move only if the asked terms are too many to be sent.
    numbered = numbered.select("grp", "term", "t")

    def part(c: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(c), parts).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    asked = terms.join(numbered, ["grp", "term"]).join(blocks, "grp").withColumn("qb", part("q", "query_parts")).withColumn("db", every("doc_parts"))
    found = postings.join(numbered, ["grp", "term"]).join(blocks, "grp").withColumn("db", part("doc", "doc_parts")).withColumn("qb", every("query_parts"))
    keys = ["grp", "qb", "db"]
    n = min(int(total), _MOST_PARTITIONS)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((terms, "grp"), (terms, "q"), (postings, "doc"))}
    return (
        asked.select(*keys, "q", "t", "qw").repartition(n, *keys).groupBy(*keys)
        .cogroup(found.select(*keys, "doc", F.col("t").alias("dt"), "w").repartition(n, *keys).groupBy(*keys))
        .applyInArrow(_score_block(k), f"grp {kinds['grp']}, q {kinds['q']}, doc {kinds['doc']}, score double")
    )


def _codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in ascending order, null first, and the place of each row's value among them."""
    values = pc.unique(column)
    values = values.take(pc.sort_indices(values, null_placement="at_start"))
    return values, pc.index_in(column, value_set=values).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _entries(row: np.ndarray, t: np.ndarray, weight: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights sorted by row and term, those of the same cell added up."""
    cell = row * n_terms + t
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    weight = np.add.reduceat(weight[order], first) if len(first) else weight
    return cell[first] // n_terms, cell[first] % n_terms, weight


def _block_products(q_rows, d_rows, n_q: int, n_d: int, n_terms: int):
    """Yield ``(first query, scores)`` of some queries with all documents of a block.

    Terms of many documents are columns of a dense product, the others are added query by query.
    """
    q, qt, qw = q_rows
    d, dt, dw = d_rows
    by_term = np.argsort(dt, kind="stable")
    d, dw = d[by_term], dw[by_term]
    edge = np.searchsorted(dt[by_term], np.arange(n_terms + 1))
    n_posts = np.diff(edge)
    common = np.flatnonzero(n_posts * _COMMON > n_d)
    common = common[np.argsort(-n_posts[common], kind="stable")][: max(1, _CELLS // n_d)]
    column = np.full(n_terms, -1)
    column[common] = np.arange(len(common))
    dense = np.zeros((len(common), n_d))
    for i, t in enumerate(common.tolist()):
        dense[i, d[edge[t] : edge[t + 1]]] = dw[edge[t] : edge[t + 1]]
    step = max(1, _CELLS // n_d)
    starts = np.searchsorted(q, np.arange(n_q + 1))
    for low in range(0, n_q, step):
        high = min(n_q, low + step)
        own = slice(starts[low], starts[high])
        row, t, weight = q[own] - low, qt[own], qw[own]
        often = column[t] >= 0
        wanted = np.zeros((high - low, len(common)))
        wanted[row[often], column[t[often]]] = weight[often]
        scores = wanted @ dense
        for r, x, w in zip(row[~often].tolist(), t[~often].tolist(), weight[~often].tolist()):
            if n_posts[x]:
                at = slice(edge[x], edge[x + 1])
                scores[r, d[at]] += w * dw[at]
        yield low, scores


def _score_block(k: int):
    """Arrow co-group function: the best k documents of a block for each of its queries."""

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table([asked["grp"].slice(0, 0), asked["q"].slice(0, 0), found["doc"].slice(0, 0), pa.array([], pa.float64())], ["grp", "q", "doc", "score"])
        if not asked.num_rows or not found.num_rows:
            return empty
        terms, qt = _codes(asked["t"])
        dt = pc.index_in(found["dt"], value_set=terms)
        found, dt = found.filter(pc.is_valid(dt)), dt.drop_null().combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        if not found.num_rows:
            return empty
        queries, q = _codes(asked["q"])
        docs, d = _codes(found["doc"])
        q_rows = _entries(q, qt, asked["qw"].to_numpy(), len(terms))
        d_rows = _entries(d, dt, found["w"].to_numpy(), len(terms))
        size = len(queries), len(docs), len(terms)
        # a document without any of the query's terms is none of its results, whatever the others score
        touched = None
        if (q_rows[2] <= 0).any() or (d_rows[2] <= 0).any():
            ones = [(r, t, np.ones(len(w))) for r, t, w in (q_rows, d_rows)]
            touched = _block_products(*ones, *size)
        out = []
        for low, scores in _block_products(q_rows, d_rows, *size):
            scores[(next(touched)[1] if touched else scores) <= 0] = -np.inf
            row, col = best_of(scores, k)
            out.append((row + low, col, scores[row, col]))
        row, col, score = map(np.concatenate, zip(*out))
        grp = pa.chunked_array([asked["grp"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(row), np.int64)))])
        return pa.table([grp, queries.take(pa.array(row)), docs.take(pa.array(col)), pa.array(score)], ["grp", "q", "doc", "score"])

    return run


def rank_topk(scored: DataFrame, k: int) -> DataFrame:
    """Rank by score, ties by lowest id; only k rows per query and task are shuffled."""
    w = W.partitionBy("grp", "q").orderBy(F.desc(F.round("score", _TIE)), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unfold_copies(best: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Replace each representative by its copies and rank again."""
    full = (
        best.drop("rank")
        .join(members, ["grp", "doc"])
        .select("grp", "q", F.col("member").alias("doc"), "score")
    )
    return rank_topk(full, k)
