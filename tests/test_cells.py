"""Vectors in cells: the threshold self-join and the approximate index, against brute force."""

import numpy as np
import pytest

from ticketloom.operators import cells, dense
from ticketloom.plans.queries import QUERIES
from ticketloom.sources import files


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def clustered(seed=0, tight=1200, apart=400, dims=16):
    """Clusters, vectors apart from them, and copies."""
    r = np.random.default_rng(seed)
    centres = unit(r.standard_normal((25, dims)))
    x = np.vstack([centres[r.integers(0, 25, tight)] + 0.08 * r.standard_normal((tight, dims)), r.standard_normal((apart, dims))])
    x = unit(x).astype(np.float32)
    return np.vstack([x, x[:30], np.repeat(x[7:8], 200, axis=0)])


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(a) for a in v], "c") for i, v in zip(ids, x)], "id long, vec array<float>, unit string")


def brute_pairs(x, ids, threshold):
    lowest = {}
    for i, v in zip(ids.tolist(), map(tuple, x.tolist())):
        lowest[v] = min(i, lowest.get(v, 1 << 60))
    reps = sorted((i, v) for v, i in lowest.items())
    m = np.array([v for _, v in reps], np.float32).astype(float)
    a, b = np.nonzero(np.triu(np.round(m @ m.T, 12) >= threshold, 1))
    return {(reps[i][0], reps[j][0]) for i, j in zip(a, b)}, {i: lowest[v] for i, v in zip(ids.tolist(), map(tuple, x.tolist()))}


@pytest.mark.parametrize("threshold,group_rows,norms", [(0.97, None, False), (0.8, 50, False), (2.0, 128, True), (-0.5, 300, False)])
def test_threshold_join_equals_brute_force(spark, threshold, group_rows, norms):
    """Groups smaller than a cluster make stripes of one cell; with norms the largest norm bounds a cell."""
    x = clustered(tight=600, apart=200) if threshold > 0 else clustered(tight=100, apart=50)
    r = np.random.default_rng(1)
    if norms:
        x = x * r.uniform(0.2, 3, (len(x), 1)).astype(np.float32)
    ids = r.permutation(len(x)) * 3 + 1
    pairs, members = cells.near_dup_pairs(frame(spark, x, ids), threshold, group_rows)
    want, lowest = brute_pairs(x, ids, threshold)
    rows = [(p.a, p.b) for p in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {m.id: m.representative for m in members.collect()} == lowest


def test_ten_thousand_equal_vectors_are_one_row_of_the_join(spark):
    x = np.vstack([np.repeat(unit(np.ones((1, 8))), 10_000, axis=0), unit(np.eye(8)[:3] + 0.9)]).astype(np.float32)
    pairs, members = cells.near_dup_pairs(frame(spark, x, np.arange(len(x))), 0.9)
    want, _ = brute_pairs(x, np.arange(len(x)), 0.9)
    assert {(p.a, p.b) for p in pairs.collect()} == want and 0 < len(want) < 10
    assert members.filter("representative = 0").count() == 10_000


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 0.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    pairs, members = cells.near_dup_pairs(df, 0.9)
    assert pairs.count() == 0
    assert sorted((m.id, m.representative) for m in members.collect()) == [(1, 1), (1, 1), (6, 1)]
    empty, none = cells.near_dup_pairs(df.limit(0), 0.9)
    assert empty.count() == none.count() == 0
    with pytest.raises(ValueError):
        cells.near_dup_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0])], "id long, vec array<float>"), 0.9)


def test_layout_keeps_groups_bounded():
    layout = cells.Layout.of(np.array([10, 0, 250, 30, 90, 5]), 100)
    assert layout.stripes.tolist() == [1, 1, 3, 1, 1, 1]
    assert layout.units(np.array([2, 4])).tolist() == [2, 3, 4, 6]
    rows = np.repeat(np.array([10, 0, 250, 30, 90, 5]) / layout.stripes, layout.stripes)
    assert np.bincount(layout.group, rows).max() <= 100 and (np.diff(layout.group) >= 0).all()
    order = cells.in_order(unit(np.random.default_rng(0).standard_normal((33, 4))))
    assert sorted(order.tolist()) == list(range(33))


@pytest.mark.parametrize("data", ["clustered", "random"])
def test_approximate_search_meets_its_recall_in_every_tenth(spark, tmp_path, data):
    x = clustered() if data == "clustered" else unit(np.random.default_rng(3).standard_normal((800, 32))).astype(np.float32)
    df = frame(spark, x, np.arange(len(x)))
    path = f"file://{tmp_path}/index"
    files.sink_index(path, df.select("id"), df.select("id", "vec"), cells=cells.build_vector_index(df, 15))
    index = files.load_index(spark, path)["cells"]
    assert files.load_index(spark, path)["text"] is None
    queries = df.filter("id % 4 = 0").selectExpr("id as q", "vec")
    got, want = {}, {}
    for r in cells.dense_topk_ivf(queries, index, 15, "others").collect():
        got.setdefault(r.q, {})[r["rank"]] = r
    for r in dense.dense_topk(queries, df, 15, None, "others").collect():
        want.setdefault(r.q, []).append(r.score)
    assert got.keys() == want.keys()
    recall = np.sort([sum(r.score >= min(want[q]) - 1e-9 for r in got[q].values()) / len(want[q]) for q in want])
    assert min(t.mean() for t in np.array_split(recall, 10)) >= 0.9
    meta = index.meta.first()
    assert meta.lowest >= 0.9 and (meta.visited < 0.5 or data == "random")
    for q, found in got.items():
        assert sorted(found) == list(range(1, 16)) and q not in {r.id for r in found.values()}
        assert [r.score for _, r in sorted(found.items())] == sorted((r.score for r in found.values()), reverse=True)
    with pytest.raises(ValueError):
        cells.dense_topk_ivf(queries, index, 16)


def test_cells_grow_with_the_root_of_the_rows():
    assert [cells.centre_count(n, 64) for n in (1, 100, 10_000, 10**8)] == [1, 10, 100, 10_000]
    assert cells.centre_count(10**14, 64) * 64 * 8 <= cells.CENTRE_BYTES


def test_a_small_table_is_searched_whole(spark):
    x = unit(np.random.default_rng(0).standard_normal((9, 4))).astype(np.float32)
    df = frame(spark, x, np.arange(9))
    found = cells.dense_topk_ivf(df.selectExpr("id as q", "vec"), cells.build_vector_index(df, 15), 15, "others")
    assert found.count() == 9 * 8


def test_queries_in_blocks_of_any_size_find_the_same(spark, monkeypatch):
    """A block of few numbers takes one query at a time; ids may repeat, and ties go to the lower id."""
    x = clustered(tight=300, apart=100)
    df = frame(spark, x, np.arange(len(x)) // 2)
    index = cells.build_vector_index(df, 15)
    found = []
    for numbers in (cells._SCORES, 1):
        monkeypatch.setattr(cells, "_SCORES", numbers)
        best = cells.dense_topk_ivf(df.selectExpr("id as q", "vec"), index, 15, "others").collect()
        found.append(sorted((r.q, r["rank"], r.id, round(r.score, 9)) for r in best))
    assert found[0] == found[1] and all(q != i for q, _, i, _ in found[0])


def test_the_registered_search_asks_every_fiftieth_vector(spark, tmp_path):
    x = unit(np.random.default_rng(5).standard_normal((160, 8))).astype(np.float32)
    rows = [(int(i), [float(a) for a in v], int(i % 3)) for i, v in zip(range(7, 167), x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["dense_topk_ivf"](spark, str(tmp_path)).collect()
    assert {r.q for r in found} == {50, 100, 150}
    best = dense.dense_topk(*(spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr(f"vec_id as {c}", "embedding as vec") for c in ("q", "id")), 15, None, "others")
    want = {(r.q, r.id) for r in best.collect() if r.q % 50 == 0}
    assert len(found) == 45 and len({(r.q, r.id) for r in found} & want) >= 0.9 * len(want)
