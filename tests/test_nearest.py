"""Nearest neighbours from pivots against a full scan, and how much is read."""

import numpy as np
import pytest

from tessera.operators import nearest, search

DDL = "id long, embedding array<float>"


def clusters(n, size, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, size))
    return [(i, [float(x) for x in centers[i % 30] + spread * rng.normal(size=size)]) for i in range(n)]


@pytest.mark.parametrize(("size", "spread", "pivots"), [(8, 0.05, 64), (3, 2.0, 5), (16, 1.0, 1)])
def test_as_a_full_scan(spark, tmp_path, size, spread, pivots):
    data = clusters(900, size, 1, spread)
    data += [(1000, None), (1001, []), (1002, [1.0] * (size + 1)), (1003, data[5][1]), (1004, data[5][1])]
    vectors = spark.createDataFrame(data, DDL)
    table = nearest.build(vectors, str(tmp_path / "t"), pivots)
    for query in (data[5][1], [0.0] * size, [9.0] * size, [1.0] * (size + 1)):
        want = [(r.id, round(r.distance, 9)) for r in search.knn(vectors, query, 12).collect()]
        found, report = table.knn(query, 12)
        assert [(r.id, round(r.distance, 9)) for r in found.collect()] == want
        assert report.rows <= report.of_rows == 904


def test_little_is_read_of_clustered_vectors(spark, tmp_path):
    data = clusters(3000, 16, 2)
    table = nearest.build(spark.createDataFrame(data, DDL), str(tmp_path / "t"))
    _, report = table.knn(data[7][1], 10)
    assert report.rows < 600 and report.rings < report.of_rings / 3


def test_no_vectors(spark, tmp_path):
    table = nearest.build(spark.createDataFrame([], DDL), str(tmp_path / "t"))
    assert table.knn([1.0], 3)[0].count() == 0
