"""Whitening against numpy on whole integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int"


def expected(rows, most=4):
    """By id: deviation and whitened rows; with n, shares."""
    x = np.floor(np.array([r for _, r in rows], np.float32).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    w = (x - s / n) @ u / np.sqrt(e)
    return n, ((n * x - s) ** 2).sum(1), w, e / np.trace(v)


def check(found, rows):
    n, deviation, w, shares = expected(rows)
    k = w.shape[1]
    assert len(found) == len(rows) * k and {r.n for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = []
    for c in range(1, k + 1):
        mine = np.array([by[i, c][0].whitened for i, _ in rows])
        signs.append(np.sign(mine @ w[:, c - 1]))
        np.testing.assert_allclose(mine * signs[-1], w[:, c - 1], atol=1e-9)
        assert by[rows[0][0], c][0].explained == pytest.approx(shares[c - 1], rel=1e-9)
    for (i, _), want in zip(rows, deviation, strict=True):
        assert {r.deviation for c in range(1, k + 1) for r in by[i, c]} == {int(want)}
    assert found[0].identity_error < 1e-9


def table(spark, rows):
    return spark.createDataFrame([(i, v, 9) for i, v in rows], SCHEMA)


def test_whitening_equals_numpy(spark, monkeypatch):
    """Over several blocks of rows and of columns; one vector on a third of the rows; odd rows left out."""
    monkeypatch.setattr(whitening, "CELLS", 256)
    monkeypatch.setattr(whitening, "COLUMNS", 4)
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 10)) @ np.diag([3, 2.5, 2, 1.5, 1, 0.7, 0.5, 0.4, 0.3, 0.2]) + 2
    rows = [(i, [float(x) for x in np.float32(base[0 if i % 3 == 0 else i])]) for i in range(700)]
    odd = [(9_001, None), (9_002, [float("nan")] * 10), (9_003, [float("inf")] + [0.0] * 9), (9_004, [None] + [1.0] * 9)]
    check(whitening.whiten(table(spark, rows + odd)).collect(), rows)


def test_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(e).collect(), [(r.vec_id, r.embedding) for r in e.collect()])


def test_odd_tables(spark):
    t = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(t).collect() == []  # one distinct vector varies in nothing
    assert whitening.whiten(t.limit(0)).collect() == []
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).collect() == []
    assert whitening.whiten(t.limit(0)).columns == [c.split()[0] for c in whitening.SHAPE.split(", ")]
    two = whitening.whiten(table(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 3.0, 0.0]), (2, [2.0, 3.0, 0.0]), (None, [1.0, 2.0, 0.0])])).collect()
    assert sorted((r.vec_id or -1, r.component) for r in two) == [(-1, 1), (1, 1), (2, 1), (2, 1)]  # two vectors span one direction
    assert {abs(round(r.whitened, 9)) for r in two} == {1.0} and two[0].explained == pytest.approx(1)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_floor_of_negative_entries(spark):
    x = whitening.usable(table(spark, [(1, [-0.001, 0.0039, -1.0, 0.5])])).select(F.col("x")).first().x
    assert x == [-1, 0, -256, 128]
