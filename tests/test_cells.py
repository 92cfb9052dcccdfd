"""Pruned vector search against the tiles: the same rows, fewer cells."""

import numpy as np
import pytest

from tessera.operators import cells as K
from tessera.operators import search as S


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "vec_id long, embedding array<float>")


def clustered(seed=1, groups=25, size=40, width=16):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(groups, width))
    rows = [(g * size + k, means[g] + 0.1 * rng.normal(size=width)) for g in range(groups) for k in range(size)]
    rows += [(5000, np.zeros(width)), (5001, None), (5002, rows[3][1]), (5003, [1.0, 2.0]), (5004, []), (5005, rows[3][1])]
    return rows


@pytest.mark.parametrize("k", [1, 4])
def test_the_same_rows_as_all_tiles_and_most_cells_skipped(spark, k):
    v = frame(spark, clustered())
    asked = v.where("vec_id % 7 = 0 or vec_id >= 5000")
    want = sorted(map(tuple, S.vector_top_k(v, asked, k).select("qid", "id", "sim", "rank").collect()))
    ranks, used = K.pruned_top_k(K.build_cells(v), asked, k)
    assert want == sorted(map(tuple, ranks.select("qid", "id", "sim", "rank").collect()))
    used = used.collect()
    assert sum(r.searched for r in used) < 0.3 * sum(r.cells for r in used)


def test_vectors_without_clusters(spark):
    rng = np.random.default_rng(3)
    v = frame(spark, [(k, rng.normal(size=8)) for k in range(300)])
    want = sorted(map(tuple, S.vector_top_k(v, v.where("vec_id < 40"), 3).select("qid", "id", "sim", "rank").collect()))
    assert want == sorted(map(tuple, K.pruned_top_k(K.build_cells(v, cells=10), v.where("vec_id < 40"), 3)[0].select("qid", "id", "sim", "rank").collect()))


def test_one_row_and_none(spark):
    v = frame(spark, [(1, [1.0, 0.0])])
    assert K.pruned_top_k(K.build_cells(v), v, 3)[0].count() == 0
    assert [tuple(r)[:3] for r in K.pruned_top_k(K.build_cells(v), frame(spark, [(2, [1.0, 1.0])]), 3)[0].select("qid", "id", "sim").collect()] == [(2, 1, 0.707107)]
    assert K.pruned_top_k(K.build_cells(v.limit(0)), v, 3)[0].count() == 0


@pytest.mark.parametrize("least", [0.2, 0.45, 0.9])
def test_sparse_pairs_above_a_threshold_are_all_pairs(spark, least):
    rng = np.random.default_rng(4)
    rows = lambda n, seed: [(k, int(b), float(rng.integers(1, 6))) for k in range(n) for b in rng.choice(60, size=rng.integers(1, 25), replace=False)]
    a, b = rows(60, 1), rows(50, 2)
    b += [(100 + k, bucket, w) for k, bucket, w in a if k < 10]  # some are alike

    def unit(rows):
        length = {}
        for k, _, w in rows:
            length[k] = length.get(k, 0.0) + w * w
        return [(k, bucket, w / length[k] ** 0.5) for k, bucket, w in rows]

    a, b = unit(a), unit(b)
    want = {}
    for i, x, v in a:
        for j, y, w in b:
            if x == y:
                want[i, j] = want.get((i, j), 0.0) + v * w
    schema = "id long, bucket int, weight double"
    got = {(r.a_id, r.b_id): r.sim for r in S.sparse_threshold_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), least).collect()}
    assert got.keys() == {p for p, s in want.items() if round(s, 6) >= least} and all(abs(want[p] - s) < 1e-6 for p, s in got.items()) and len(got) >= 10
    assert S.sparse_threshold_join(spark.createDataFrame(a, schema), spark.createDataFrame([], schema), least).count() == 0
