import numpy as np

from bandloom.llm import nearest


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scores = sorted((-float(np.dot(q, v) / (np.sqrt(q @ q) * np.sqrt(v @ v))), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = scores[:k]
    return out


def check(spark, rows, least):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want, got = brute(rows), {}
    for r in nearest.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(mine, mine[1:], strict=False))
        hits += len({v for _, v, _ in mine} & {j for _, j in best})
        total += len(best)
    assert hits >= least * total
    return got


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(2500)]
    rows += [(i, rows[0][1]) for i in range(3000, 3400)]  # a large group of copies
    rows += [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [None] + [1.0] * 23), (None, rows[1][1]), (9200, [1.0, 2.0]), (9250, [2.0, 4.0]), (9300, [3.0, -1.0])]
    got = check(spark, rows, 0.95)
    assert [v for _, v, _ in sorted(got[0])] == [3000, 3001, 3002, 3003, 3004]
    assert [v for _, v, _ in sorted(got[3000])] == [0, 3001, 3002, 3003, 3004]
    assert [v for _, v, _ in sorted(got[9200])] == [9250, 9300]


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], 1)
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_every_query_gets_all_its_neighbours(spark, monkeypatch):
    """Queries that lie alone, each in a list of its own, look into further lists."""
    monkeypatch.setattr(nearest.Lists, "_enough", lambda self, units, k, rng: 1)
    rng = np.random.default_rng(4)
    rows = [(i + 1 + i // 49, (np.eye(16)[3] + 0.01 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(50 * (1000 + i), (10 * np.eye(16)[i] * (-1) ** i).tolist()) for i in range(16)]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    asked = {i for i, _ in rows if i % 50 == 0}
    assert got.keys() == asked and all(len(v) == 5 and len({j for _, j in v}) == 5 for v in got.values())


def test_doubles_are_scored_as_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (201, [x * (1 + 1e-12 * (k % 3)) for k, x in enumerate(rows[0][1])])]
    v = {i: np.array(x) for i, x in rows}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        a, b = v[r["query_id"]], v[r["vec_id"]]
        assert abs(r["score"] - float((a * b).sum() / (np.sqrt(a @ a) * np.sqrt(b @ b)))) < 1e-15


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    units = rng.standard_normal((5000, 64))
    units /= np.sqrt((units**2).sum(1, keepdims=True))
    q = units[7] + 0.3 * rng.standard_normal(64) / 8
    q /= np.sqrt(q @ q)
    found = nearest.scan(units @ nearest.rotation(64), q @ nearest.rotation(64), 6)
    assert set(np.argsort(-(units @ q))[:6]) <= set(found)


def test_very_large_and_very_small_entries(spark):
    """Squares of these overflow or vanish; the cosines are those of the plain vectors."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    scale = [1e200, 1e-200, 1e300, 1e-300, 1.0]
    rows = [(i, [float(x) for x in v * scale[i % 5]]) for i, v in enumerate(base)]
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=3).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        near = unit @ unit[q]
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-near[i], i))[:3]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [i for _, i, _ in mine] == want
        np.testing.assert_allclose([s for _, _, s in mine], near[want], rtol=1e-12)
