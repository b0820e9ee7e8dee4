"""Vectors in cells: a threshold self-join and an approximate index.

Every vector lies in the cell of its nearest centre.  Cells are numbered so that
near ones follow each other, and consecutive cells make a group of bounded size; a cell beyond that is
dealt into stripes by a hash of the id.  A task holds the residents of one group and
lets the visitors stream past them in blocks, so no task holds more than a group and a batch.
Centres grow with the square root of the rows until they take ``CENTRE_BYTES``; then cells grow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ticketloom.operators.dense import best_of, dense_topk
from ticketloom.session import materialize

CENTRE_BYTES = 64 << 20
GROUP_ROWS = 16_384
BLOCK = 512
_SCORES = 1 << 22  # numbers of a block product that a task holds at a time
_SLACK = 1e-6  # angles come from rounded cosines


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def centre_count(rows: int, dims: int) -> int:
    return max(1, min(math.ceil(math.sqrt(rows)), CENTRE_BYTES // (8 * dims)))


def in_order(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which near ones follow each other: halves by two far ones, again and again."""
    out, todo = [], [np.arange(len(centres))]
    while todo:
        own = todo.pop()
        if len(own) < 3:
            out.extend(own.tolist())
            continue
        x = centres[own]
        far = x[np.argmin(x @ x[0])]
        along = np.argsort(x @ (far - x[0]), kind="stable")
        todo += [own[along[len(own) // 2 :]], own[along[: len(own) // 2]]]
    return np.array(out)


@dataclass
class Layout:
    """Stripes of each cell and groups of stripes; one number for each cell, so small."""

    first: np.ndarray  # of each cell, its first stripe
    stripes: np.ndarray
    group: np.ndarray  # of each stripe

    @classmethod
    def of(cls, sizes: np.ndarray, group_rows: int) -> "Layout":
        stripes = np.maximum(1, -(-sizes // group_rows)).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(stripes)))[:-1]
        rows = np.repeat(sizes / stripes, stripes)
        group, held, g = np.empty(len(rows), np.int32), 0.0, 0
        for i, n in enumerate(rows):
            if held and held + n > group_rows:
                g, held = g + 1, 0.0
            group[i] = g
            held += n
        return cls(first, stripes, group)

    def units(self, cells: np.ndarray) -> np.ndarray:
        """All stripes of some cells."""
        return np.concatenate([np.arange(self.first[c], self.first[c] + self.stripes[c]) for c in cells.tolist()] or [np.empty(0, int)])


def placed_in(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, vec, cell, angle, norm``."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            cell, angle, norm = np.empty(len(x), np.int32), np.empty(len(x)), np.linalg.norm(x, axis=1) if len(x) else np.empty(0)
            for at in range(0, len(x), BLOCK):
                s = slice(at, at + BLOCK)
                near = (x[s] / norm[s, None]) @ centres.T
                cell[s] = near.argmax(axis=1)
                angle[s] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vec"), pa.array(cell), pa.array(angle), pa.array(norm)], ["id", "vec", "cell", "angle", "norm"]
            )

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("id", "vec").mapInArrow(run, f"id long, vec {kind}, cell int, angle double, norm double")


def _resident(placed: DataFrame, layout: Layout) -> DataFrame:
    """``grp, kind, id, vec, unit, angle, units`` of the rows that a group holds."""
    first, stripes, group = layout.first, layout.stripes, layout.group

    def run(batches):
        for b in batches:
            cell, salt = b.column("cell").to_numpy(), b.column("salt").to_numpy()
            unit = first[cell] + salt % stripes[cell]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[unit]), pa.array(np.zeros(len(cell), np.int32)), b.column("id"), b.column("vec"),
                    pa.array(unit), b.column("angle"), pa.nulls(len(cell), pa.list_(pa.int64())),
                ],
                ["grp", "kind", "id", "vec", "unit", "angle", "units"],
            )

    kind = placed.schema["vec"].dataType.simpleString()
    rows = placed.select("id", "vec", "cell", "angle", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"))
    return rows.mapInArrow(run, f"grp int, kind int, id long, vec {kind}, unit long, angle double, units array<long>")


def _meet(residents: DataFrame, visitors: DataFrame, groups: int, hold, pass_, schema: str) -> DataFrame:
    """``hold(residents of a group)`` gives a state and rows of its own, ``pass_(state, visitors)`` the rows of each batch that streams past."""

    def run(batches):
        grp, held, state = None, [], None
        for b in batches:
            g, kind = b.column("grp").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)]):
                if a == z:
                    continue
                if g[a] != grp:
                    if held:
                        yield from hold(pa.Table.from_batches(held))[1]
                    grp, held, state = g[a], [], None
                if kind[a] == 0:
                    held.append(b.slice(a, z - a))
                    continue
                if held:
                    state, rows = hold(pa.Table.from_batches(held))
                    yield from rows
                    held = []
                if state is not None:
                    yield from pass_(state, b.slice(a, z - a))
        if held:
            yield from hold(pa.Table.from_batches(held))[1]

    both = residents.unionByName(visitors)
    return both.repartition(groups, "grp").sortWithinPartitions("grp", "kind", "unit", "angle", "id").mapInArrow(run, schema)


# ---- threshold self-join ---------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``id, vec``: vectors that are not null, zero or partly null or not finite; all must be of one length."""
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select("id", "vec").filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(good)


def near_dup_pairs(vectors: DataFrame, threshold: float, group_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of vectors with an inner product (the cosine, if norms are 1) of at least ``threshold``.

    ``(a, b, similarity)`` with a < b between representatives, the lowest id of each distinct vector, and
    ``(id, representative, similarity)`` for every vector (similarity: to its copies).  No pair is lost.

    Excluded before they are formed: a vector does not visit a cell whose largest norm
    times its own is below the threshold, nor one that lies, by the triangle inequality on angles, beyond the angle
    that the threshold allows; in a cell it meets the ring of residents whose angles to
    the centre are that near to its own.  Each two cells meet once: the later one's vectors visit.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    folded = materialize(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-vectors")
    own = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    members = rows.join(folded.select("vec", F.col("id").alias("representative")), "vec").select("id", "representative", own.alias("similarity"))
    shape = folded.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(2).collect()
    if not shape:
        return spark.createDataFrame([], "a long, b long, similarity double"), members
    if len(shape) > 1:
        raise ValueError("vectors have different lengths")
    n, dims = shape[0].n, shape[0].d
    if group_rows is None:
        group_rows = min(GROUP_ROWS, max(1024, n // (2 * spark.sparkContext.defaultParallelism)))
    chosen = folded.orderBy(F.xxhash64("id"), "id").limit(centre_count(n, dims)).select("vec").collect()
    centres = _unit(np.array([r.vec for r in chosen], np.float64))
    centres = centres[in_order(centres)]
    placed = materialize(placed_in(folded, centres), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"), F.max("norm").alias("norm")).collect()
    sizes, radius, norm = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf), np.zeros(len(centres))
    for c in cells:  # one row for each centre
        sizes[c.cell], radius[c.cell], norm[c.cell] = c.n, c.r, c.norm
    layout = Layout.of(sizes, group_rows)
    cell_of = np.repeat(np.arange(len(centres)), layout.stripes)

    def reach(norms, cells):
        """The widest angle to a vector of each cell that the threshold allows; below zero: none."""
        most = norms[:, None] * norm[cells]
        with np.errstate(divide="ignore"):
            out = np.arccos(np.clip(threshold / most, -1, 1)) if threshold > 0 else np.full(most.shape, np.pi)
        return np.where(most >= threshold, out + _SLACK, -np.inf)

    def route(batches):
        for b in batches:
            x, cell, salt = _matrix(b.column("vec")), b.column("cell").to_numpy(), b.column("salt").to_numpy()
            size, home = b.column("norm").to_numpy(), layout.first[cell] + salt % layout.stripes[cell]
            for at in range(0, len(x), BLOCK):
                s = np.arange(at, min(at + BLOCK, len(x)))
                angle = np.arccos(np.clip((x[s] / size[s, None]) @ centres.T, -1, 1))
                every = np.arange(len(centres))
                open_ = (angle <= radius + reach(size[s], every)) & (every <= cell[s][:, None])
                i, c = np.nonzero(open_)
                unit = layout.units(c)
                i = np.repeat(i, layout.stripes[c])
                before = unit < home[s[i]]
                to = np.unique(np.column_stack((s[i[before]], layout.group[unit[before]])), axis=0)
                rows = pa.array(to[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to[:, 1].astype(np.int32)), pa.array(np.ones(len(to), np.int32)), b.column("id").take(rows),
                        b.column("vec").take(rows), pa.array(home[to[:, 0]]), b.column("angle").take(rows), pa.nulls(len(to), pa.list_(pa.int64())),
                    ],
                    ["grp", "kind", "id", "vec", "unit", "angle", "units"],
                )

    def pairs(x, y, score):
        a, b = np.minimum(x, y), np.maximum(x, y)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["a", "b", "similarity"])

    def against(state, ids, x, unit):
        """Pairs of a block with the held units before its own."""
        held, at, angles, vecs = state
        size = np.linalg.norm(x, axis=1)
        units = np.array(list(at))
        turned = np.arccos(np.clip((x / size[:, None]) @ centres[cell_of[units]].T, -1, 1))
        widest = reach(size, cell_of[units])
        for k, u in enumerate(units.tolist()):
            some = np.flatnonzero((unit > u) & (turned[:, k] <= radius[cell_of[u]] + widest[:, k]))
            if not len(some):
                continue
            some = some[np.argsort(turned[some, k], kind="stable")]
            a, z = at[u]
            low = np.searchsorted(angles[a:z], turned[some, k] - widest[some, k]) + a
            high = np.searchsorted(angles[a:z], turned[some, k] + widest[some, k], side="right") + a
            for part in range(0, len(some), 64):
                p = some[part : part + 64]
                f, t = int(low[part : part + 64].min()), int(high[part : part + 64].max())
                for q in range(f, t, 8192):
                    score = np.round(x[p] @ vecs[q : min(q + 8192, t)].T, 12)
                    i, j = np.nonzero(score >= threshold)
                    if len(i):
                        yield pairs(ids[p[i]], held[q + j], score[i, j])

    def hold(rows):
        ids, unit, angles, vecs = rows.column("id").to_numpy(), rows.column("unit").to_numpy(), rows.column("angle").to_numpy(), _matrix(rows.column("vec"))
        edges = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
        state = ids, {int(unit[a]): (int(a), int(z)) for a, z in zip(edges[:-1], edges[1:])}, angles, vecs

        def inside():
            for at in range(0, len(ids), BLOCK):
                z = min(at + BLOCK, len(ids))
                yield from against(state, ids[at:z], vecs[at:z], unit[at:z])
                # within a unit: with the rows before
                for q in range(0, z, 8192):
                    to = min(q + 8192, z)
                    same = (unit[at:z, None] == unit[None, q:to]) & (np.arange(at, z)[:, None] > np.arange(q, to))
                    if same.any():
                        score = np.round(vecs[at:z] @ vecs[q:to].T, 12)
                        i, j = np.nonzero(same & (score >= threshold))
                        if len(i):
                            yield pairs(ids[at + i], ids[q + j], score[i, j])

        return state, inside()

    def pass_(state, b):
        # the group's own rows have met it already
        ids, unit = b.column("id").to_numpy(), b.column("unit").to_numpy()
        other = np.flatnonzero(layout.group[unit] != b.column("grp").to_numpy())
        x = _matrix(b.column("vec"))
        for at in range(0, len(other), BLOCK):
            k = other[at : at + BLOCK]
            yield from against(state, ids[k], x[k], unit[k])

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    kind = folded.schema["vec"].dataType.simpleString()
    visits = salted.mapInArrow(route, f"grp int, kind int, id long, vec {kind}, unit long, angle double, units array<long>")
    groups = max(int(layout.group[-1]) + 1, 2 * spark.sparkContext.defaultParallelism)
    return _meet(_resident(placed, layout), visits, groups, hold, pass_, "a long, b long, similarity double"), members


# ---- approximate index -----------------------------------------------------------------------


@dataclass
class VectorIndex:
    """A coarse quantiser with cell lists.

    ``cells``: ``(cell, centre, n, angles)``, quantiles of the angles to the centre; ``lists``: ``(id, vec, cell, angle, norm)``;
    ``meta``: one row, ``(k, cutoff, recall, lowest, visited, dims)``: for which k it was fitted, the recall of the sample, over
    all and over its worst tenth of queries, and the share of the rows that its queries visited.
    """

    cells: DataFrame
    lists: DataFrame
    meta: DataFrame

    PARTS = ("cells", "lists", "meta")

    def store(self, path: str, mode: str = "error") -> None:
        for part in self.PARTS:
            table = getattr(self, part)
            if part == "lists":
                table = table.repartitionByRange("cell").sortWithinPartitions("cell")
            table.write.mode(mode).parquet(f"{path}/{part}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorIndex":
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in cls.PARTS])


class _Quantiser:
    """The cells' numbers on their way to the tasks: at most ``CENTRE_BYTES`` and a few numbers a cell."""

    def __init__(self, cells: DataFrame):
        found = cells.orderBy("cell").collect()
        self.centres = np.array([r.centre for r in found])
        self.sizes = np.array([r.n for r in found], np.int64)
        self.angles = np.array([r.angles or [0.0] * len(QUANTILES) for r in found])
        self.dims = self.centres.shape[1]

    def near(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_unit(x) @ self.centres.T, -1, 1)

    def expected(self, near: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Log of the number of a cell's vectors that should lie above ``kth``, if each angle's lie evenly around the centre."""
        across, out = np.sqrt(1 - near * near) / math.sqrt(max(self.dims - 1, 1)), np.full(near.shape, -np.inf)
        for j, q in enumerate(QUANTILES):
            spread = np.maximum(np.sin(self.angles[:, j]) * across, 1e-9)
            z = np.maximum((kth[:, None] - np.cos(self.angles[:, j]) * near) / spread, 0.0)
            # log of the normal's tail, between its usual bounds
            tail = -z * z / 2 - np.log(z + np.sqrt(z * z + 8 / math.pi)) + 0.5 * math.log(2 / math.pi)
            stands_for = np.maximum(self.sizes / (len(QUANTILES) - 1), 1) if q < 1 else 1.0
            out = np.logaddexp(out, tail + np.log(stands_for))
        return np.where(self.sizes > 0, out, -np.inf)


QUANTILES = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)  # of the angles in a cell; the last is its farthest vector
UNMET = 0.02  # share of the sample's queries that the cutoff may fail
FIRST = 4  # cells that every query visits
TRAIN = 200_000  # vectors, at most, that the centres are learned from
SAMPLE = 200  # queries that the cutoff is fitted on


def build_vector_index(vectors: DataFrame, k: int = 15, recall: float = 0.97, seed: int = 42) -> VectorIndex:
    """Learn centres (spherical k-means on at most ``TRAIN`` vectors by hash), place all vectors, fit the cutoff.

    The cutoff is what all queries of a sample but ``UNMET`` need to meet ``recall`` of their true neighbours (by an exact search).
    """
    rows = materialize(usable(vectors), "index-vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no vectors")
    train = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    c = centre_count(n, dims)
    if c > 1:
        model = KMeans(k=c, seed=seed, maxIter=8, distanceMeasure="cosine", initSteps=1).fit(materialize(train, "train"))
        centres = _unit(np.array(model.clusterCenters()))
    else:
        centres = _unit(np.array([rows.first().vec], np.float64))
    centres = centres[in_order(centres)]
    lists = materialize(placed_in(rows, centres), "lists")
    spark = vectors.sparkSession
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cell int, centre array<double>")
    stats = lists.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("angle", list(QUANTILES), 1000).alias("angles"))
    cells = materialize(table.join(stats, "cell", "left").na.fill({"n": 0}), "cells")
    some = materialize(lists.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select(F.col("id").alias("q"), "vec"), "sample")
    true = dense_topk(some, rows, k, None, "others").select("q", "id")
    known = true.join(lists.select("id", "cell"), "id").groupBy("q").agg(F.collect_list("cell").alias("cells")).join(some, "q")
    first = _visited(some, lists, _Quantiser(cells), k, None, None, "others").groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("kth"))
    found = known.join(first, "q", "left").collect()  # SAMPLE rows of k numbers
    cutoff, met, visited = -math.inf, np.ones(1), 1.0
    if found:
        quantiser = _Quantiser(cells)
        near = quantiser.near(np.array([r.vec for r in found], np.float64))
        score = quantiser.expected(near, np.array([r.kth if r.m == k else -1.0 for r in found]))
        np.put_along_axis(score, np.argsort(-near, axis=1, kind="stable")[:, :FIRST], np.inf, axis=1)
        need = [np.sort(score[i, r.cells])[::-1][min(len(r.cells), math.ceil(recall * len(r.cells))) - 1] for i, r in enumerate(found)]
        cutoff = float(np.quantile(need, UNMET, method="lower"))
        visited = float(((score >= cutoff) @ quantiser.sizes).mean() / n)
        met = np.sort([(score[i, r.cells] >= cutoff).mean() for i, r in enumerate(found)])
    meta = spark.createDataFrame(
        [(k, cutoff, float(met.mean()), float(met[: max(1, len(met) // 10)].mean()), visited, dims)],
        "k int, cutoff double, recall double, lowest double, visited double, dims int",
    )
    return VectorIndex(cells, lists, meta)


def _visited(queries: DataFrame, lists: DataFrame, quantiser: _Quantiser, k: int, kth: DataFrame | None, cutoff: float | None, pairing: str) -> DataFrame:
    """``q, id, score, rank`` from the first cells, or, with ``kth`` and ``cutoff``, from those that remain."""
    spark = queries.sparkSession
    n = int(quantiser.sizes.sum())
    layout = Layout.of(quantiser.sizes, min(GROUP_ROWS, max(1024, n // (2 * spark.sparkContext.defaultParallelism))))
    asked = queries.select(F.col("q").alias("id"), "vec")
    if kth is not None:
        asked = asked.join(kth.select(F.col("q").alias("id"), "kth"), "id", "left")
    else:
        asked = asked.withColumn("kth", F.lit(None).cast("double"))
    kind = queries.schema["vec"].dataType.simpleString()

    def route(batches):
        for b in batches:
            x, floor = _matrix(b.column("vec")), b.column("kth").to_numpy(zero_copy_only=False).astype(float)
            for at in range(0, len(x), 64):
                near = quantiser.near(x[at : at + 64])
                first = np.argsort(-near, axis=1, kind="stable")[:, :FIRST]
                open_ = np.zeros(near.shape, bool)
                if cutoff is not None:
                    open_ = quantiser.expected(near, np.nan_to_num(floor[at : at + 64], nan=-1.0)) >= cutoff
                np.put_along_axis(open_, first, cutoff is None, axis=1)
                owner, units, groups = [], [], []
                for i in range(len(near)):
                    unit = layout.units(np.flatnonzero(open_[i] & (quantiser.sizes > 0)))
                    for g in np.unique(layout.group[unit]):
                        owner.append(at + i)
                        groups.append(g)
                        units.append(unit[layout.group[unit] == g])
                rows = pa.array(owner, pa.int64())
                lists_ = pa.ListArray.from_arrays(
                    np.cumsum([0, *map(len, units)], dtype=np.int32), np.concatenate([np.empty(0, np.int64), *units])
                )
                m = len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(groups, pa.int32()), pa.array(np.ones(m, np.int32)), b.column("id").take(rows), b.column("vec").take(rows),
                        pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), lists_,
                    ],
                    ["grp", "kind", "id", "vec", "unit", "angle", "units"],
                )

    def hold(rows):
        rows = rows.sort_by("id")  # ties go to the lower id
        units, at = np.unique(rows.column("unit").to_numpy(), return_inverse=True)
        return (rows.column("id").to_numpy(), units, at, _matrix(rows.column("vec"))), ()

    def pass_(state, b):
        ids, units, at, vecs = state
        x, step, out = _matrix(b.column("vec")), max(1, _SCORES // len(ids)), []
        for low in range(0, len(x), step):
            part = b.slice(low, step)
            q, lists_ = part.column("id").to_numpy(), part.column("units")
            asked_of = np.repeat(np.arange(len(q)), lists_.value_lengths().to_numpy())
            wanted = lists_.flatten().to_numpy()
            place = np.minimum(np.searchsorted(units, wanted), len(units) - 1)
            held = units[place] == wanted
            open_ = np.zeros((len(q), len(units)), bool)
            open_[asked_of[held], place[held]] = True
            some = open_.any(axis=0)[at]  # rows that one of these queries visits at least
            score = x[low : low + step] @ vecs[some].T
            score[~open_[:, at[some]]] = -np.inf
            if pairing == "others":
                score[q[:, None] == ids[some][None, :]] = -np.inf
            row, col = best_of(score, k)
            out.append((q[row], ids[some][col], np.round(score[row, col], 12)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "id", "score"])

    groups = max(int(layout.group[-1]) + 1, 2 * spark.sparkContext.defaultParallelism)
    visits = asked.mapInArrow(route, f"grp int, kind int, id long, vec {kind}, unit long, angle double, units array<long>")
    found = _meet(_resident(lists, layout), visits, groups, hold, pass_, "q long, id long, score double")
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_topk_ivf(queries: DataFrame, index: VectorIndex, k: int = 15, pairing: str = "all") -> DataFrame:
    """Approximate ``dense_topk`` over a stored index: ``(q, id, score, rank)``.

    Every query visits its nearest cells; its k-th score there tells, cell by cell, how many better vectors
    to expect, and it goes on to all cells above the fitted cutoff.  So a query among few neighbours visits more
    cells than one in a cluster, and one that has not met k vectors yet visits all.
    Only unit-norm vectors; ``pairing`` as for ``dense_topk`` (all, others).
    """
    meta = index.meta.first()
    if k > meta.k:
        raise ValueError(f"the index was fitted for k = {meta.k}")
    if pairing not in ("all", "others"):
        raise ValueError(pairing)
    quantiser = _Quantiser(index.cells)
    asked = usable(queries.withColumnRenamed("q", "id")).withColumnRenamed("id", "q")
    first = materialize(_visited(asked, index.lists, quantiser, k, None, None, pairing).drop("rank"), "first-cells")
    kth = first.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("kth")).select("q", F.when(F.col("m") == k, F.col("kth")).alias("kth"))
    more = _visited(asked, index.lists, quantiser, k, kth, meta.cutoff, pairing).drop("rank")
    return _best(first.unionByName(more), k)
