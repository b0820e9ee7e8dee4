"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product.  Every vector x, of norm at most M, becomes the unit
vector (x / M, sqrt(1 - |x|^2 / M^2)), a query q becomes (q / |q|, 0); the nearest by
distance are then the largest by inner product.  A table cuts ``m`` Gaussian projections
into cells of width ``width``; m is half of log2 of the rows, so that buckets
and their number grow alike.  A query visits its own bucket and perturbed ones (a cell up or down in some
projections) in the order of the expected distance to them, which is fixed for
the ranks of a query's projections and thus computed once.

How many buckets to visit is fitted: the true neighbours of ``SAMPLE`` queries, found
by a scan of all rows, tell how far down the order their buckets stand; the least
number that finds ``recall`` of them is taken for all queries.  Every row is indexed.
The sample's queries also tell how far away a k-th neighbour may be before this number of buckets finds too few: those
tenths of them, from the farthest on, that miss ``LOWEST`` set a bound.  A query whose k-th found neighbour lies beyond the
bound, or beyond all of the sample, or that met fewer than k, is compared with every row, in blocks.

Queries and vectors meet by partitions of buckets, a vector once for each partition that
holds a bucket of it.  Buckets beyond ``BUCKET_ROWS`` rows are split and visited piece
by piece, so there is no cap.  A partition keeps the best k + 1 of each query, in double precision on the
original vectors.  Equal vectors are one entry with their k + 1 smallest ids, which is all that a result can name.

With no more entries than k, every query meets all of them.  An empty table gives no rows; columns other than the two named ones
are not looked at.  Null ids, and vectors that are null, zero, not all finite or not of the commonest
length take no part.  Of several vectors under one id the smallest is taken.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.llm.common import materialize

TABLES = 10
WIDTH = 2.5
RECALL = 0.96
LOWEST = 0.9  # recall of a tenth of the sample's queries below which queries as far away are compared with every row
SAMPLE = 100
MOST_PROBES = 6000
BUCKET_ROWS = 50_000
PART_ROWS = 100_000
SEED = 11


@lru_cache(maxsize=8)
def perturbations(m: int, most: int) -> np.ndarray:
    """The best sets of cell moves, as bits over the 2m moves by rank, in expected order of distance.

    Rank j and 2m - 1 - j are the two moves of one projection and exclude each other.
    """
    j = np.arange(1, m + 1, dtype=float)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = np.arange(m + 1, 2 * m + 1, dtype=float)
    far = 1 - (2 * m + 1 - k) / (m + 1) + (2 * m + 1 - k) * (2 * m + 2 - k) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate((near, far)).tolist()
    out, heap = [0], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, moves = heapq.heappop(heap)
        last = moves[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*moves, last + 1)))
        if all(2 * m - 1 - x not in moves for x in moves):
            out.append(sum(1 << x for x in moves))
    return np.array(out, np.int64)


class Hashes:
    """The projections of all tables, from the seed."""

    def __init__(self, dims: int, m: int, tables: int, width: float, scale: float, seed: int = SEED):
        self.m, self.tables, self.width, self.scale = m, tables, width, scale
        rng = np.random.default_rng([seed, dims, m, tables])
        self.a = rng.standard_normal((dims + 1, tables * m))
        self.b = rng.uniform(0, width, tables * m)
        self.mix = rng.integers(1, 2**62, (tables, m + 1)).astype(np.uint64) | np.uint64(1)

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.m)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Cells (real numbers) of indexed vectors."""
        x = x / self.scale
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return self._cells(np.column_stack((x, rest)))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self._cells(np.column_stack((q / np.linalg.norm(q, axis=1)[:, None], np.zeros(len(q)))))

    def codes(self, cells: np.ndarray, table: int | None = None) -> np.ndarray:
        """A number for each bucket of cells (.., tables, m), or of one table's cells (.., m)."""
        mix = self.mix if table is None else self.mix[table]
        c = np.floor(cells).astype(np.int64).astype(np.uint64)
        h = (c * mix[..., : self.m]).sum(axis=-1, dtype=np.uint64) + mix[..., self.m]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))).astype(np.int64)

    def ranked(self, cells: np.ndarray) -> np.ndarray:
        """For each rank, the move there: 2 * projection + (0 down, 1 up)."""
        f = cells - np.floor(cells)
        return np.argsort(np.stack((f, 1 - f), axis=-1).reshape(*f.shape[:-1], 2 * self.m), axis=-1, kind="stable")

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """Codes of the first n buckets of each query in each table: (queries, tables, n)."""
        cells, sets = self.queries(q), perturbations(self.m, MOST_PROBES)[:n]
        moves = self.ranked(cells)
        bits = (sets[:, None] >> np.arange(2 * self.m)) & 1  # sets x ranks
        by_move = np.zeros((*moves.shape[:-1], len(sets), 2 * self.m), np.int8)
        np.put_along_axis(by_move, np.broadcast_to(moves[..., None, :], by_move.shape), np.broadcast_to(bits, by_move.shape).astype(np.int8), -1)
        delta = by_move[..., 1::2] - by_move[..., 0::2]
        moved = np.floor(cells)[..., None, :] + delta
        return np.stack([self.codes(moved[:, t], t) for t in range(self.tables)], axis=1)

    def places(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of pairs, where the query's order reaches the vector's bucket first, over all tables."""
        sets = perturbations(self.m, MOST_PROBES)
        by_bits = np.argsort(sets)
        own, cells = self.queries(q), self.rows(x)
        delta = (np.floor(cells) - np.floor(own)).astype(np.int64)
        moves = self.ranked(own)
        up, down = delta == 1, delta == -1
        taken = np.stack((down, up), axis=-1).reshape(*delta.shape[:-1], 2 * self.m)
        bits = (np.take_along_axis(taken, moves, -1).astype(np.int64) << np.arange(2 * self.m)).sum(axis=-1)
        at = np.minimum(np.searchsorted(sets[by_bits], bits), len(sets) - 1)
        place = np.where((sets[by_bits][at] == bits) & (np.abs(delta) <= 1).all(axis=-1), by_bits[at], MOST_PROBES)
        return place.min(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products that don't depend on what else is in the block."""
    return (x * q).sum(axis=1)


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    ).filter(finite)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame, id_: str, vector: str, every: int, k: int = 20, tables: int = TABLES, width: float = WIDTH, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_, vector).withColumn("d", F.size("v")), "vectors")
    shape = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dims, k1 = shape[0].d, k + 1
    rows = rows.filter(F.col("d") == dims).drop("d")
    # equal vectors: one entry; a window's limit is applied in each task before the shuffle
    order = W.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k1)
    entries = materialize(
        few.groupBy("v").agg(F.min("id").alias("e"), F.array_sort(F.collect_list("id")).alias("ids")), "entries"
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, scale = entries.agg(F.count("*"), F.max(square)).first()
    m = max(2, round(np.log2(max(n, 2)) / 2))
    hashes = Hashes(dims, m, tables, width, float(np.sqrt(scale)) * (1 + 1e-9))

    asked = materialize(rows.filter(F.col("id") % every == 0).join(entries.select("v", "e"), "v").select(F.col("id").alias("query_id"), "e"), "asked")
    queries = materialize(entries.select("e", "v").join(asked.select("e").distinct(), "e"), "queries")
    probes, bound = fitted_probes(entries, queries, hashes, k1, recall)

    coded = entries.select("e", "v").mapInArrow(_coder(hashes, None), "e long, code long")
    coded = materialize(coded, "codes")
    large = coded.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
    large = materialize(large.select("code", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("pieces")), "large-buckets")
    parts = max(int(-(-n * tables // PART_ROWS)), 2 * spark.sparkContext.defaultParallelism)
    piece = F.pmod(F.xxhash64("e"), F.coalesce("pieces", F.lit(1))).cast("int")
    part = F.pmod(F.xxhash64("code", "piece"), F.lit(parts)).cast("int")
    index = coded.join(large, "code", "left").withColumn("piece", piece)
    visits = materialize(queries.mapInArrow(_coder(hashes, probes), "e long, code long"), "visits").join(large, "code", "left")
    visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))

    def side(codes, kind):
        key = F.xxhash64("code", "piece").alias("code")
        sent = codes.select("e", part.alias("part"), key).groupBy("e", "part").agg(F.collect_set("code").alias("codes"))
        return sent.join(entries.select("e", "v"), "e").select(F.lit(kind).alias("kind"), "part", "e", "v", "codes")

    both = side(index, 0).union(side(visits, 1))

    def compared(rows, n_parts):
        return rows.repartitionById(n_parts, "part").sortWithinPartitions("part", "kind").mapInArrow(
            _meet(k1), "q long, e long, score double"
        )

    met = materialize(compared(both, parts), "met")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    first = met.groupBy("q", "e").agg(F.max("score").alias("score"))
    first = first.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "e"))).filter(F.col("r") <= k1)
    first = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    far = queries.join(first, F.col("e") == F.col("q"), "left").filter(
        F.coalesce(F.col("n") < k1, F.lit(True)) | (F.col("kth") / length < bound)
    )
    far = materialize(far.select("e", "v"), "far-queries")
    if far.limit(1).count():
        one = F.array(F.lit(0).cast("long")).alias("codes")
        blocks = max(int(-(-n // PART_ROWS)), spark.sparkContext.defaultParallelism)
        all_rows = entries.select(F.lit(0).alias("kind"), F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int").alias("part"), "e", "v", one)
        asked_all = far.select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "e", "v", one)
        met = met.union(compared(all_rows.union(asked_all), blocks))
    merged = met.groupBy("q", "e").agg(F.max("score").alias("score"))
    named = merged.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("id"))
    ranked = named.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    own = asked.join(lists, asked["e"] == lists["q"])
    found = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(found).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score")
    )


def _coder(hashes: Hashes, probes: int | None):
    """Buckets of entries, or the buckets that queries visit."""

    def run(batches):
        for b in batches:
            ids = b.column("e").to_numpy()
            x = _matrix(b.column("v"))
            for at in range(0, len(ids), 32 if probes else 4096):
                part = slice(at, at + (32 if probes else 4096))
                codes = hashes.codes(hashes.rows(x[part])) if probes is None else hashes.probes(x[part], probes)
                codes = codes.reshape(len(ids[part]), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[part], codes.shape[1])), pa.array(codes.ravel())], ["e", "code"]
                )

    return run


def _meet(k: int):
    """Best k entries of each query among a partition's entries; entries come before queries."""

    def run(batches):
        part, ids, xs, codes, owners, out, index = None, [], [], [], [], [], None

        def rows():
            columns = list(zip(*out)) if out else [()] * 3
            joined = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(columns, (np.int64, np.int64, np.float64))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in joined], ["q", "e", "score"])

        for b in batches:
            kinds, parts = b.column("kind").to_numpy(), b.column("part").to_numpy()
            e, x, lists = b.column("e").to_numpy(), _matrix(b.column("v")), b.column("codes")
            flat, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (parts[1:] != parts[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(e)]):
                if parts[a] != part:
                    part, ids, xs, codes, owners, index = parts[a], [], [], [], [], None
                if kinds[a] == 0:
                    codes.append(flat[edges[a] : edges[z]])
                    owners.append(np.repeat(np.arange(a, z) - a + sum(map(len, ids)), np.diff(edges[a : z + 1])))
                    ids.append(e[a:z])
                    xs.append(x[a:z])
                    continue
                if not ids:
                    continue
                if index is None:
                    c, o = np.concatenate(codes), np.concatenate(owners)
                    order = np.argsort(c, kind="stable")
                    index = c[order], o[order], np.concatenate(ids), np.concatenate(xs)
                c, o, all_ids, all_x = index
                for i in range(a, z):
                    asked = flat[edges[i] : edges[i + 1]]
                    lo, hi = np.searchsorted(c, asked), np.searchsorted(c, asked, side="right")
                    hit = np.flatnonzero(hi > lo)
                    if not len(hit):
                        continue
                    seen = np.zeros(len(all_ids), bool)
                    for j in hit:
                        seen[o[lo[j] : hi[j]]] = True
                    some = np.flatnonzero(seen)
                    score = _products(all_x[some], x[i])
                    best = _best(score, all_ids[some], k)
                    out.append((np.full(len(best), e[i]), all_ids[some][best], score[best]))
                if len(out) > 2000:
                    yield rows()
        yield rows()

    return run


def fitted_probes(entries: DataFrame, queries: DataFrame, hashes: Hashes, k: int, recall: float) -> tuple[int, float]:
    """Buckets to visit in each table so that ``recall`` of the sample's true neighbours are met, and the bound.

    The bound is the least inner product with the query's direction that a k-th neighbour may have.
    """
    some = queries.orderBy(F.xxhash64("e"), "e").limit(SAMPLE).select("e", "v").collect()
    if not some:
        return 1, np.inf
    q = np.array([r.v for r in some], float)

    def scan(batches):
        for b in batches:
            e, x = b.column("e").to_numpy(), _matrix(b.column("v"))
            out = []
            for i in range(len(q)):
                score = _products(x, q[i])
                best = _best(score, e, k)
                out.append(pd.DataFrame({"i": np.int32(i), "score": score[best], "e": e[best], "row": best}))
            d = pd.concat(out)
            place = hashes.places(q[d["i"]], x[d["row"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["i"], pa.int32()), pa.array(d["score"]), pa.array(d["e"]), pa.array(place, pa.int64())],
                ["i", "score", "e", "place"],
            )

    found = entries.select("e", "v").mapInArrow(scan, "i int, score double, e long, place long")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "e"))).filter(F.col("r") <= k)
    known = top.select("i", "score", "place").toPandas()  # SAMPLE x k rows
    places = np.sort(known["place"])
    probes = int(min(MOST_PROBES, places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1))
    known["met"] = known["place"] < probes
    by_query = known.groupby("i").agg(kth=("score", "min"), met=("met", "mean"))
    by_query["kth"] /= np.linalg.norm(q, axis=1)[by_query.index]
    bound = by_query["kth"].min()
    by_query = by_query.sort_values("kth")
    for tenth in (by_query.iloc[t] for t in np.array_split(np.arange(len(by_query)), 10)):
        if not len(tenth) or tenth["met"].mean() >= LOWEST:
            break
        bound = np.nextafter(tenth["kth"].max(), np.inf)
    return probes, float(bound)
