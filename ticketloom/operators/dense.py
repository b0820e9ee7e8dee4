"""Exact nearest neighbours over unit-norm vectors.

Vectors are spread over cells (nearest pivot) and hash stripes of bounded
size.  Each (query stripe, corpus stripe) pair is one Arrow co-group: a block
product in NumPy that keeps only the local top k.  A cell is visited only when
the triangle inequality on angles leaves room for a better neighbour, so the
answer stays exact while far cells are skipped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ticketloom.session import materialize

_TIE = 9
_LANE = 64
_NEAR = 1e-8  # scores this near may be ties
_SLACK = 1e-6  # vectors are unit-norm only up to float32 rounding
_MAX_CELLS = 256
_CELL_ROWS = 200_000
_STRIPE_ROWS = 8_192
_MOST_PARTITIONS = 10_000

_OUT = "q long, id long, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    merged = column.combine_chunks()
    if len(merged) == 0:
        return np.zeros((0, 0))
    return merged.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(merged), -1)


def best_of(scores: np.ndarray, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest finite numbers of each row, in order; ties go to the lower column.

    The k-th largest among the largest of each lane of a row is a bound for its k-th largest number, so few are ranked.
    """
    n, width = scores.shape
    lanes = width // _LANE
    least = np.full(n, -np.inf)
    if lanes >= k:
        tops = scores[:, : lanes * _LANE].reshape(n, lanes, _LANE).max(axis=2)
        least = np.partition(tops, lanes - k, axis=1)[:, lanes - k]
    row, col = np.nonzero(scores >= least[:, None] - _NEAR)
    score = np.round(scores[row, col], 12)
    kept = np.isfinite(score) if floor is None else np.isfinite(score) & (score >= floor)
    row, col, score = row[kept], col[kept], score[kept]
    order = np.lexsort((col, -np.round(score, _TIE), row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def _block_topk(k: int, floor: float | None, pairing: str):
    """Arrow co-group function: local top k of every query in the block."""

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        out_q, out_id, out_score = [], [], []
        if queries.num_rows and corpus.num_rows:
            corpus = corpus.sort_by("id")
            ids = corpus["id"].to_numpy()
            vectors = _matrix(corpus["vec"])
            q_ids = queries["q"].to_numpy()
            q_vectors = _matrix(queries["vec"])
            for start in range(0, len(q_ids), 512):
                block = q_ids[start : start + 512]
                scores = q_vectors[start : start + 512] @ vectors.T
                if pairing == "others":
                    scores[block[:, None] == ids[None, :]] = -np.inf
                elif pairing == "earlier":
                    scores[block[:, None] <= ids[None, :]] = -np.inf
                row, col = best_of(scores, k, floor)
                out_q.append(block[row])
                out_id.append(ids[col])
                out_score.append(np.round(scores[row, col], 12))
        join = np.concatenate
        return pa.table(
            {
                "q": pa.array(join(out_q) if out_q else [], pa.int64()),
                "id": pa.array(join(out_id) if out_id else [], pa.int64()),
                "score": pa.array(join(out_score) if out_score else [], pa.float64()),
            }
        )

    return run


def _stripes(rows: int) -> int:
    return max(1, math.ceil(rows / _STRIPE_ROWS))


def _salt(id_col: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), parts).cast("int")


def _block_join(
    queries: DataFrame, corpus: DataFrame, q_parts: dict, c_parts: dict, k, floor, pairing
) -> DataFrame:
    """Meet every query stripe of a cell with every corpus stripe of that cell."""

    def lookup(parts: dict) -> Column:
        # at most _MAX_CELLS entries
        if not parts:
            return F.lit(1)
        pairs = [x for cell, n in sorted(parts.items()) for x in (F.lit(int(cell)), F.lit(int(n)))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("cell")), F.lit(1))

    def series(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = (
        queries.withColumn("qs", _salt("q", lookup(q_parts)))
        .withColumn("cs", series(lookup(c_parts)))
        .select("cell", "qs", "cs", "q", "vec")
    )
    right = (
        corpus.withColumn("cs", _salt("id", lookup(c_parts)))
        .withColumn("qs", series(lookup(q_parts)))
        .select("cell", "qs", "cs", "id", F.col("vec").alias("vec"))
    )
    keys = ["cell", "qs", "cs"]
    blocks = sum(q_parts.get(c, 1) * c_parts.get(c, 1) for c in {**q_parts, **c_parts})
    n = min(max(1, blocks), _MOST_PARTITIONS)  # as many partitions as block pairs, so that tasks have few each
    left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _block_topk(k, floor, pairing), _OUT
    )


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("q").orderBy(F.desc(F.round("score", _TIE)), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 15,
    floor: float | None = None,
    pairing: str = "all",
    cells: int | None = None,
) -> DataFrame:
    """Exact top k by inner product: ``(q, id, score, rank)``.

    ``queries``: ``(q long, vec array<float>)``; ``corpus``: ``(id long, vec)``;
    all vectors unit-norm.  ``pairing`` is ``all``, ``others`` (skip the same
    id) or ``earlier`` (only ids below the query's).  ``floor`` drops weaker
    neighbours.  ``cells`` defaults to one per 200,000 corpus rows, 256 at most.
    """
    n_corpus = corpus.count()
    if cells is None:
        cells = min(_MAX_CELLS, max(1, math.ceil(n_corpus / _CELL_ROWS)))
    if cells == 1:
        flat_q = queries.select("q", "vec", F.lit(0).alias("cell"))
        flat_c = corpus.select("id", "vec", F.lit(0).alias("cell"))
        q_parts, c_parts = {0: _stripes(queries.count())}, {0: _stripes(n_corpus)}
        return _rank(_block_join(flat_q, flat_c, q_parts, c_parts, k, floor, pairing), k)
    return _topk_with_cells(queries, corpus, k, floor, pairing, min(cells, _MAX_CELLS))


def _topk_with_cells(queries, corpus, k, floor, pairing, cells) -> DataFrame:
    # Pivots: at most _MAX_CELLS vectors, chosen by a hash of the id.
    chosen = corpus.orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells).collect()
    pivots = np.array([r["vec"] for r in chosen], dtype=np.float64)

    @F.pandas_udf("cell int, angle double")
    def nearest_pivot(vec: pd.Series) -> pd.DataFrame:
        if len(vec) == 0:
            return pd.DataFrame({"cell": np.array([], "int32"), "angle": np.array([], "float64")})
        sims = np.stack(vec.to_numpy()).astype(np.float64) @ pivots.T
        best = sims.argmax(axis=1)
        angle = np.arccos(np.clip(sims[np.arange(len(best)), best], -1, 1))
        return pd.DataFrame({"cell": best.astype("int32"), "angle": angle})

    placed = materialize(
        corpus.withColumn("at", nearest_pivot("vec")).select("id", "vec", "at.cell", "at.angle"), "placed"
    )
    homes = materialize(queries.withColumn("at", nearest_pivot("vec")).select("q", "vec", "at.cell"), "homes")
    # One row per cell, at most _MAX_CELLS.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()
    c_parts = {r["cell"]: _stripes(r["n"]) for r in sizes}
    radius = np.full(len(pivots), -np.inf)
    for r in sizes:
        radius[r["cell"]] = r["r"]
    home_sizes = homes.groupBy("cell").agg(F.count("*").alias("n")).collect()
    q_parts = {r["cell"]: _stripes(r["n"]) for r in home_sizes}

    block_corpus = placed.select("id", "vec", "cell")
    first = materialize(
        _rank(_block_join(homes, block_corpus, q_parts, c_parts, k, floor, pairing), k), "nearest"
    )
    known = (
        first.groupBy("q")
        .agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        .select("q", F.when(F.col("n") == k, F.col("kth")).alias("kth"))
    )
    floor_value = -1.0 if floor is None else float(floor)

    @F.pandas_udf("array<int>")
    def open_cells(vec: pd.Series, home: pd.Series, kth: pd.Series) -> pd.Series:
        if len(vec) == 0:
            return pd.Series([], dtype=object)
        angles = np.arccos(np.clip(np.stack(vec.to_numpy()).astype(np.float64) @ pivots.T, -1, 1))
        bound = np.cos(np.clip(angles - radius[None, :], 0, np.pi))
        bound[:, ~np.isfinite(radius)] = -np.inf
        need = np.maximum(kth.fillna(-1.0).to_numpy(), floor_value) - _SLACK
        keep = bound >= need[:, None]
        keep[np.arange(len(keep)), home.to_numpy()] = False
        return pd.Series([np.flatnonzero(row).astype("int32") for row in keep])

    routed = materialize(
        homes.join(known, "q", "left").select(
            "q", "vec", F.explode(open_cells("vec", "cell", "kth")).alias("cell")
        ),
        "routed",
    )
    # Stripes follow the queries that really visit a cell; again one row per cell.
    visits = routed.groupBy("cell").agg(F.count("*").alias("n")).collect()
    visit_parts = {r["cell"]: _stripes(r["n"]) for r in visits}
    visited = block_corpus.filter(F.col("cell").isin(list(visit_parts)))
    second = _block_join(routed, visited, visit_parts, c_parts, k, floor, pairing)
    return _rank(first.drop("rank").unionByName(second), k)
