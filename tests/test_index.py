"""The inverted-file index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import index, vectors


def frame(spark, v):
    return spark.createDataFrame([(i, x if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")


def brute(v, queries, k):
    u = index.units(np.array([x if x is not None else [0.0] * 8 for x in v], float))
    real = [i for i, x in enumerate(v) if x is not None]
    out = {}
    for q in queries:
        if v[q] is not None:
            ranked = sorted((-(round(float(u[q] @ u[i]), 9) + 0.0), i) for i in real if i != q)[:k]
            out[q] = [(i, -c) for c, i in ranked]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r.id, r.cosine))
    return out


@pytest.fixture(scope="module")
def clustered():
    """40 tight clusters, one with a third of all rows, exact copies, zero vectors and nulls."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    at = np.where(rng.random(1200) < 0.33, 0, rng.integers(0, 40, 1200))
    v = [list(centres[c] + rng.normal(size=8) * 0.05) for c in at]
    v[7] = v[3] = v[1199]
    v[11], v[500], v[20], v[900] = None, None, [0.0] * 8, [0.0] * 8
    return v


@pytest.mark.parametrize("cells", [1, 30, None])
def test_exact(spark, clustered, cells, monkeypatch):
    monkeypatch.setattr(index, "CHUNK", 100)
    monkeypatch.setattr(index, "BLOCK", 16)
    d = frame(spark, clustered)
    got = index.search(index.build(d, "id", "v", cells), d.where("id % 20 = 0"), "id", "v", 5, probes=2)
    want = brute(clustered, range(0, 1200, 20), 5)
    assert {q: [(i, pytest.approx(c, abs=2e-9)) for i, c in x] for q, x in want.items()} == found(got)


def test_few_cells_are_searched(spark, clustered):
    """Where vectors have clusters, no row meets all queries: the bound ends the search after few cells."""
    d = frame(spark, clustered)
    got = index.search(index.build(d, "id", "v", 40), d.where("id % 20 = 1"), "id", "v", 5, probes=2)
    rows = got.select("query", "cells").distinct().collect()
    assert np.mean([r.cells for r in rows]) <= 10 and len(rows) == 60


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall(spark, scale):
    """All queries against brute force: vectors without any structure, so three of four cells must be searched."""
    d = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = d.where("id % 20 = 0")
    own = index.build(d, "id", "v", 30)
    truth = index.search(own, asked, "id", "v", 10)
    v = [list(map(float, r.v)) for r in d.orderBy("id").collect()]
    assert {q: [i for i, _ in x] for q, x in found(truth).items()} == {q: [i for i, _ in x] for q, x in brute(v, range(0, len(v), 20), 10).items()}
    few = index.search(own, asked, "id", "v", 10, probes=int(len(own.far) * 0.75), exact=False)
    assert index.recall(few, truth) >= 0.9


def test_near_pairs_are_all(spark, clustered):
    v = [x or [0.0] * 8 for x in clustered[:300]]
    u = index.units(np.array(v, float))
    got = {(r.a, r.b) for r in vectors.near_pairs(frame(spark, v), "id", "v", 0.1, 12).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 1 - 0.005 - 1e-12}


def test_cases(spark):
    d = frame(spark, [[1.0, 0.0], None, [0.0, 0.0]])
    own = index.build(d, "id", "v")
    assert found(index.search(own, d, "id", "v", 5)) == {0: [(2, 0.0)], 2: [(0, 0.0)]}
    assert index.search(index.build(d.limit(0), "id", "v"), d.limit(0), "id", "v", 5).count() == 0
    one = frame(spark, [[1.0, 0.0]])
    assert index.search(index.build(one, "id", "v"), one, "id", "v", 5).count() == 0
