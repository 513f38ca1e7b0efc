"""Quality by a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (logs of sizes, logits of
shares). Class means and covariances are fitted on labelled rows of the training fold; a
covariance is shrunk towards the pooled one and towards its own diagonal, and factored
once (Cholesky). The score is the logistic of the difference of the classes' Gaussian
log densities, Mahalanobis distances taken with the kept factors, plus the log prior odds.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_training_fold, sliced

#: Bound of the labelled sample on which the classes are fitted.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
POOLED, DIAGONAL = 0.3, 0.1

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KINDS = np.zeros((256, 7))
for _b in range(256):
    _kind = 0 if 97 <= _b <= 122 else 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b in b" \t\r\x0b\x0c" else 4 if _b == 10 else 5 if _b in b".,;:'\"-?" else 6
    if _b < 128:
        _KINDS[_b, _kind] = 1
N_FEATURES = 16


def statistics_of(text: str) -> np.ndarray:
    """Transformed statistics of a whole text; an empty one has them all as well."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    low = raw.translate(_FOLD)
    words = low.split()
    n, n_bytes = len(words), max(1, len(raw))
    counts = Counter(words)
    lines = [x for x in low.split(b"\n") if x.strip()]
    top = sum(c for _, c in counts.most_common(3))
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else n
    share = lambda a, b: np.log((a + 0.5) / (b - a + 0.5)) if b >= a else 0.0  # noqa: E731  logit with half a count
    letters = kinds[0] + kinds[1]
    return np.array([
        np.log1p(n), np.log1p(n_bytes / max(1, n)),
        share(kinds[1], letters), share(kinds[2], n_bytes), share(kinds[6], n_bytes), share(kinds[5], n_bytes), share(kinds[3], n_bytes),
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), share(len(lines) - len(set(lines)), len(lines)),
        share(len(counts), n), share(top, n), share(pairs, max(pairs, n)), share(sum(w[-1:] in b".!?" for w in words), n),
        share(sum(not w.isalpha() and w.isascii() and not w[:-1].isalpha() for w in words), n), np.log1p(max(map(len, words), default=0)),
    ])


class Discriminant:
    def __init__(self, means: np.ndarray, factors: np.ndarray, log_odds: float, centre: np.ndarray, scale: np.ndarray):
        """``factors``: inverses of the classes' lower Cholesky factors."""
        self.means, self.factors, self.log_odds, self.centre, self.scale = means, factors, log_odds, centre, scale
        self.half_logdet = np.array([-np.log(np.diag(f)).sum() for f in factors])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - d for m, f, d in zip(self.means, self.factors, self.half_logdet, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -30, 30)))


class Constant:
    """Where a class has no rows to learn from."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.full(len(rows), self.share)


def fit_discriminant(rows: np.ndarray, labels: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL):
    counts = [int((labels == k).sum()) for k in (0, 1)]
    if min(counts) < 2:
        return Constant(counts[1] / sum(counts) if sum(counts) else 0.5)
    centre, scale = rows.mean(0), rows.std(0) + 1e-6
    z = (rows - centre) / scale
    means = np.array([z[labels == k].mean(0) for k in (0, 1)])
    own = [np.cov(z[labels == k].T, bias=True) for k in (0, 1)]
    both = (counts[0] * own[0] + counts[1] * own[1]) / sum(counts)
    factors = []
    for cov, n in zip(own, counts, strict=True):
        weight = max(pooled, N_FEATURES / (N_FEATURES + n))  # few rows lean on the pooled estimate
        cov = (1 - weight) * cov + weight * both
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        factors.append(np.linalg.inv(np.linalg.cholesky(cov)))
    return Discriminant(means, np.array(factors), float(np.log(counts[1] / counts[0])), centre, scale)


def fit(docs: DataFrame, labels: DataFrame):
    """Learn from the training fold of ``labels(doc_id, quality)``; at most MAX_LABELLED rows, those
    of smallest hash. A document with several labels takes the largest; nulls are left out. An id
    on several rows gives the row of the least statistics. Without labels or documents every text
    scores 0.5, with labels of one class alone that class' share."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality is not null").filter(in_training_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    each = rows.select("doc_id", "quality", "text").mapInArrow(_statistics, "doc_id long, quality int, x array<double>")
    one = each.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # an id may stand on any number of rows
    found = sorted((r["quality"], tuple(r["x"])) for r in one.toLocalIterator())
    return fit_discriminant(np.array([x for _, x in found]).reshape(-1, N_FEATURES), np.array([q for q, _ in found], int))


def _statistics(batches):
    for batch in sliced(batches):
        found = pa.array([statistics_of(t).tolist() for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "quality", "x"])


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    A null text scores as an empty one. Rows that repeat an id are scored each; a null id stays
    null and counts as held out. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in sliced(batches):
            x = np.array([statistics_of(t) for t in batch.column(2).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(x), pa.float64())], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
