"""The vector index against exact neighbours: recall, certainty, hot cells, odd rows."""

import numpy as np
import pytest

from foliant.operators import search as S
from foliant.operators import vectors as V

SCHEMA = "vec_id long, label int, embedding array<double>"


def cloud(spark, n=3000, dims=64, seed=3):
    """Vectors around 40 loose centres, a third of them around one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 40, n))
    data = centres[of] + 0.7 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, int(rng.integers(0, 5)), [float(x) for x in v]) for i, v in enumerate(data)], SCHEMA)


def pairs(df):
    return {(r["vec_id"], r["other_id"], r["score"], r["rank"]) for r in df.select("vec_id", "other_id", "score", "rank").collect()}


def test_recall_and_certainty(spark, tmp_path):
    vectors = cloud(spark)
    queries = vectors.filter("vec_id % 20 = 0")
    index = V.build(vectors, str(tmp_path / "index"), cells=32)
    assert spark.read.parquet(index.path).count() == 3000 == index.rows.sum()
    exact = pairs(S.nearest_of_others(queries, vectors, 5))
    found = V.nearest_by_index(index, queries, 5, probes=6, block=200)
    got = pairs(found)
    assert len({x[:2] for x in got} & {x[:2] for x in exact}) >= 0.95 * len(exact)
    sure = {r["vec_id"] for r in found.filter("certain").collect()}
    assert {x for x in got if x[0] in sure} == {x for x in exact if x[0] in sure}
    every = V.nearest_by_index(index, queries, 5, probes=32, block=100)
    assert pairs(every) == exact and every.filter("NOT certain").isEmpty()


def test_far_groups_are_certain_with_one_probe(spark, tmp_path):
    rows = [(i, i % 2, [1.0 if j == i % 8 else 0.001 * (i + j) / 100 for j in range(8)]) for i in range(160)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = V.build(vectors.unionByName(vectors.selectExpr("vec_id + 1000 AS vec_id", "label + 1 AS label", "embedding")), str(tmp_path / "index"), cells=8)
    found = V.nearest_by_index(index, vectors, 3, probes=1)
    assert found.count() == 480 and found.filter("certain").count() > 0


def test_odd_rows_and_bounds(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.1]), (3, 2, [0.0, 0.0]), (4, 2, None), (5, 2, [None, 1.0]), (None, 2, [1.0, 0.0]), (6, 2, [float("nan"), 1.0]), (7, 1, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = V.build(vectors, str(tmp_path / "index"), cells=1)
    assert index.rows.tolist() == [2]
    assert {x[:2] for x in pairs(V.nearest_by_index(index, vectors, 5, probes=1))} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        V.build(vectors.limit(0), str(tmp_path / "none"), cells=4)
    with pytest.raises(ValueError):
        V.build(vectors, str(tmp_path / "many"), cells=10**6)


def test_exact_answers_by_the_index_are_those_of_all_cells(spark, tmp_path):
    import random

    rnd = random.Random(8)
    rows = [(i, i % 3, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    index = V.build(vectors, str(tmp_path / "exact"), cells=6)
    got, all_ = (sorted((r["vec_id"], r["rank"], r["other_id"], r["score"]) for r in x.collect()) for x in (V.exact_by_index(index, vectors, 5, probes=1), V.nearest_by_index(index, vectors, 5, probes=6)))
    assert got == all_ and len(got) == 1500
