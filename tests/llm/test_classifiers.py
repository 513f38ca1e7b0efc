import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bandloom.llm import quality, toxicity
from bandloom.llm.common import held_out

SF = "/root/testdata/sf0.1"


def accuracy(scored, labels, name):
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", name).collect()
    return np.mean([r["predicted"] == r[name] for r in rows]), len(rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    share, n = accuracy(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic")
    assert n > 500 and share > 0.97


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    share, n = accuracy(quality.score(docs, quality.fit(docs, labels)), labels, "quality")
    assert n > 500 and share > 0.97


def test_folds(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out(F.col("doc_id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} good text {'vile' if i % 3 == 0 else 'kind'}") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    wrong = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, wrong).weights


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "a " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for module in (toxicity, quality):
        found = module.score(docs, module.fit(docs, none)).collect()
        assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)
        assert module.score(docs.limit(0), module.fit(docs.limit(0), none)).collect() == []


def test_nnpu_finds_the_telling_words():
    rng = random.Random(0)
    doc = lambda bad: sorted({rng.randrange(300) for _ in range(30)} | ({rng.choice([300, 301])} if bad else set()))
    positive, unlabelled = [doc(True) for _ in range(200)], [doc(rng.random() < 0.15) for _ in range(1500)]
    w, bias = toxicity.fit_nnpu(positive, unlabelled, 302, 0.15)
    assert w[300] + w[1] + w[2] + bias > 0 > w[1] + w[2] + w[3] + bias


def plain_nnpu(positive, unlabelled, n, prior, steps, rate, decay):
    """The risk's steps by loops over documents and features."""
    w, moments = [0.0] * n + [math.log(prior / (1 - prior))], [[0.0, 0.0] for _ in range(n + 1)]
    s = lambda x: 1 / (1 + math.exp(-x))
    went_back = 0
    for step in range(1, steps + 1):
        g = lambda d: w[n] + sum(w[f] for f in d)
        risk_u = sum(math.log1p(math.exp(g(d))) for d in unlabelled) / len(unlabelled)
        risk_p = sum(math.log1p(math.exp(g(d))) for d in positive) / len(positive)
        below = risk_u - prior * risk_p < 0
        went_back += below
        grad = [decay * v / math.sqrt(n) for v in w[:n]] + [0.0]
        for d in positive:
            plus, minus = prior * (s(g(d)) - 1) / len(positive), -prior * s(g(d)) / len(positive)
            for f in [*d, n]:
                grad[f] += -minus if below else plus + minus
        for d in unlabelled:
            for f in [*d, n]:
                grad[f] += (-1 if below else 1) * s(g(d)) / len(unlabelled)
        for f in range(n + 1):
            m = moments[f]
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad[f], 0.999 * m[1] + 0.001 * grad[f] ** 2
        w = [v - rate * (m[0] / (1 - 0.9**step)) / (math.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) for v, m in zip(w, moments, strict=True)]
    return w, went_back


def test_nnpu_takes_the_steps_of_a_plain_loop():
    rng = random.Random(4)
    doc = lambda bad: sorted({rng.randrange(20) for _ in range(4)} | ({20} if bad else set()))
    positive, unlabelled = [doc(True) for _ in range(8)], [doc(rng.random() < 0.3) for _ in range(30)]
    plain, went_back = plain_nnpu(positive, unlabelled, 21, 0.4, 120, 0.1, 1e-3)
    w, bias = toxicity.fit_nnpu(positive, unlabelled, 21, 0.4, steps=120, rate=0.1)
    assert went_back > 0  # both kinds of step are taken
    assert np.allclose([*w, bias], plain, rtol=1e-6, atol=1e-8)


def test_telling_features_are_those_of_a_plain_count(spark):
    rng = random.Random(9)
    rows = [(rng.random() < 0.3, True, [f"f{int(rng.paretovariate(0.4)) % 60}".encode() for _ in range(6)] + ([b"x"] if rng.random() < 0.2 else [])) for _ in range(300)]
    rows = [(p, u, sorted(set(f + ([b"bad"] if p else [])))) for p, u, f in rows]
    n_p, n_u = sum(p for p, *_ in rows), len(rows)
    want = []
    for f in {f for *_, fs in rows for f in fs}:
        a, b = sum(p and f in fs for p, _, fs in rows), sum(f in fs for *_, fs in rows)
        share = (a + b + 1) / (n_p + n_u + 2)
        z = abs(a / n_p - b / n_u) / math.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
        if a + b >= toxicity.LEAST_SEEN and z > toxicity.LEAST_Z:
            want.append((-z, f))
    found = toxicity.telling(spark.createDataFrame(rows, "positive boolean, unlabelled boolean, features array<binary>"), n_p, n_u)
    assert [bytes(r["feature"]) for r in found.collect()] == [f for _, f in sorted(want)]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "t", True), (2, None, None, None, None)], "doc_id long, text string, score int, positive string, held_out boolean")
    none = spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, toxic int, quality int, text string")
    for module in (toxicity, quality):
        found = module.score(docs, module.fit(docs, none))
        assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 2


def test_remove_toxic_keeps_columns(spark):
    model = toxicity.Lexicon({b"vile": 9.0}, -3.0)
    docs = spark.createDataFrame([(1, "VILE!", "k"), (2, None, "k"), (3, "fine", None)], "doc_id long, text string, score string")
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_discriminant_is_that_of_a_plain_loop():
    """Shrunk covariances and log densities, by loops and a solver instead of kept factors."""
    rng = np.random.default_rng(5)
    d = quality.N_FEATURES
    x, y = rng.normal(size=(60, d)) * rng.uniform(0.5, 3, d), np.array([0, 1, 1] * 20)
    centre = [sum(r[j] for r in x) / len(x) for j in range(d)]
    scale = [math.sqrt(sum((r[j] - centre[j]) ** 2 for r in x) / len(x)) + 1e-6 for j in range(d)]
    z = [[(r[j] - centre[j]) / scale[j] for j in range(d)] for r in x]
    mean, cov, n = {}, {}, {}
    for k in (0, 1):
        own = [r for r, q in zip(z, y, strict=True) if q == k]
        n[k] = len(own)
        mean[k] = [sum(r[j] for r in own) / n[k] for j in range(d)]
        cov[k] = [[sum((r[i] - mean[k][i]) * (r[j] - mean[k][j]) for r in own) / n[k] for j in range(d)] for i in range(d)]
    shrunk = {}
    for k in (0, 1):
        w = max(quality.POOLED, d / (d + n[k]))
        both = [[(n[0] * cov[0][i][j] + n[1] * cov[1][i][j]) / 60 for j in range(d)] for i in range(d)]
        mixed = [[(1 - w) * cov[k][i][j] + w * both[i][j] for j in range(d)] for i in range(d)]
        shrunk[k] = np.array([[mixed[i][j] * (1 if i == j else 1 - quality.DIAGONAL) + (1e-3 if i == j else 0) for j in range(d)] for i in range(d)])
    want = []
    for r in z:
        log = {}
        for k in (0, 1):
            off = np.array(r) - np.array(mean[k])
            log[k] = math.log(n[k] / 60) - 0.5 * (off @ np.linalg.solve(shrunk[k], off) + np.linalg.slogdet(shrunk[k])[1])
        want.append(1 / (1 + math.exp(log[0] - log[1])))
    assert np.allclose(quality.fit_discriminant(x, y).scores(x), want, rtol=1e-9, atol=1e-12)


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (400, quality.N_FEATURES)), rng.normal(1.5, 2, (400, quality.N_FEATURES))])
    y = np.repeat([0, 1], 400)
    assert ((quality.fit_discriminant(x, y).scores(x) > 0.5) == y).mean() > 0.98
