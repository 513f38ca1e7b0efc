"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; labelled rows with their labels hidden are the
unlabelled side, a sample of what texts are like whose toxic share ``pi`` is known. A linear
model over the words that tell the two apart (beginnings of words count as words) is fitted
with the risk ``pi * R+(g) + max(0, R-u(g) - pi * R-p(g))``: the negative risk is that of the
unlabelled text less the share that is toxic, and when a step would drive it below zero, that
step goes back instead. Texts are scored where they lie, in whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, held_out, in_training_fold, sliced

#: Bounds of the sample of labelled rows on which the model is fitted: toxic ones, and rows whose labels are hidden.
MAX_POSITIVE, MAX_HIDDEN = 2_000, 8_000
#: Words the model may weigh; how often the sample must show one, and how many standard
#: deviations its shares must lie apart.
MAX_WORDS, LEAST_SEEN, LEAST_Z = 4_096, 4, 3.5
THRESHOLD = 0.5

#: Words whose hash or features a worker keeps; workers live through several stages.
CACHED_WORDS = 150_000

#: ASCII letters go to lower case, other ASCII signs and white space to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def features_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings, marked as such: inflected and compound forms share them."""
    return [word, *(b"<" + word[:n] for n in (5, 6, 7) if len(word) > n)]


class _Found(dict):
    """The features of a word that the model weighs."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self._weights = weights

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in features_of(word) if f in self._weights)
        return found


class Lexicon:
    """Linear score over the distinct words of a text and their beginnings."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self._found = _Found(weights)

    def __reduce__(self):
        return Lexicon, (self.weights, self.bias)

    def score(self, text: str) -> float:
        found = {f for some in filter(None, map(self._found.__getitem__, words_of(text))) for f in some}
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[w] for w in sorted(found)), -30, 30))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(
    positive: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float,
    steps: int = 400, rate: float = 0.05, decay: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model over features ``0 .. n_features - 1``.

    A document is the list of its features. Without positives or unlabelled documents all
    weights are 0 and the bias is the prior's.
    """
    prior = min(max(prior, 1e-3), 0.999)
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return w, bias

    def flat(docs):
        sizes = [len(d) for d in docs]
        return np.repeat(np.arange(len(docs)), sizes), np.array([f for d in docs for f in d], np.int64)

    (p_row, p_word), (u_row, u_word) = flat(positive), flat(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        g_p = bias + np.bincount(p_row, w[p_word], n_p)
        g_u = bias + np.bincount(u_row, w[u_word], n_u)
        # logistic losses: of being called positive log(1+e^-g), of being called negative log(1+e^g)
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        d_plus = prior * (sigmoid(g_p) - 1) / n_p
        d_u, d_p = sigmoid(g_u) / n_u, -prior * sigmoid(g_p) / n_p
        if negative < 0:  # the estimate went below what a risk can be: go back on this part alone
            d_u, d_p, d_plus = -d_u, -d_p, 0 * d_plus
        by_feature = np.bincount(p_word, (d_plus + d_p)[p_row], n_features) + np.bincount(u_word, d_u[u_row], n_features)
        grad = np.append(by_feature + decay * w / max(1, n_features) ** 0.5, (d_plus + d_p).sum() + d_u.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def telling(rows: DataFrame, n_positive: int, n_unlabelled: int) -> DataFrame:
    """The features of ``rows(positive, unlabelled, features)`` whose share among positives lies
    well above or below that in unlabelled text: at most MAX_WORDS, the most telling ones."""
    each = rows.select("positive", "unlabelled", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.sum(F.col("positive").cast("long")).alias("a"), F.sum(F.col("unlabelled").cast("long")).alias("b"))
    share = (F.col("a") + F.col("b") + 1) / (n_positive + n_unlabelled + 2)
    apart = F.abs(F.col("a") / n_positive - F.col("b") / n_unlabelled)
    z = apart / F.sqrt(share * (1 - share) * (1 / n_positive + 1 / n_unlabelled))
    often = counts.filter(F.col("a") + F.col("b") >= LEAST_SEEN).withColumn("z", z).filter(F.col("z") > LEAST_Z)
    return often.orderBy(F.desc("z"), "feature").limit(MAX_WORDS).select("feature")


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from the training fold of ``labels(doc_id, toxic)`` and ``docs(doc_id, text)``.

    Several labels of one document count as toxic if any of them is; null ids and null
    labels are left out, as are labels without a document; of an id on several rows one text counts. Positives, and rows whose labels
    are then hidden, are those of smallest hash, up to MAX_POSITIVE and MAX_HIDDEN. Features
    are counted by Spark; the driver gets MAX_WORDS of them at most and, for each document of
    the sample, their numbers. With an empty table on either side every text scores the prior.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null").filter(in_training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    prior = counts["toxic"] / counts["n"] if counts["n"] else 0.0
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    positive = known.filter("toxic = 1").orderBy(*by_hash).limit(MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled"))
    hidden = known.orderBy(*by_hash).limit(MAX_HIDDEN).select("doc_id", F.lit(False).alias("positive"), F.lit(True).alias("unlabelled"))
    sides = [F.max(c).alias(c) for c in ("positive", "unlabelled")]
    chosen = positive.unionByName(hidden).groupBy("doc_id").agg(*sides)  # MAX_POSITIVE + MAX_HIDDEN rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shape = "positive boolean, unlabelled boolean, features array<binary>"
    with Cuts(docs.sparkSession) as cut:
        # an id may stand on any number of rows: one of its texts counts
        one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        rows = cut(one.select("positive", "unlabelled", "text").mapInArrow(_features, shape))
        n = rows.agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")).first()
        words = [bytes(r["feature"]) for r in telling(rows, n["p"], n["u"]).collect()] if n["p"] and n["u"] else []
        index = {w: i for i, w in enumerate(words)}
        numbers = rows.mapInArrow(_numbered(index), "positive boolean, unlabelled boolean, ids array<int>")
        # sorted: the same model in whatever order rows come
        found = sorted((r["ids"], r["positive"], r["unlabelled"]) for r in numbers.collect())
    weights, bias = fit_nnpu([x for x, p, _ in found if p], [x for x, _, u in found if u], len(words), prior)
    return Lexicon({w: float(v) for w, v in zip(words, weights, strict=True) if abs(v) > 1e-6}, bias)


def _features(batches):
    for batch in sliced(batches):
        found = [sorted({f for w in words_of(t) for f in features_of(w)}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["positive", "unlabelled", "features"])


def _numbered(index: dict[bytes, int]):
    def run(batches):
        for batch in sliced(batches):
            ids = [sorted(index[f] for f in some if f in index) for some in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["positive", "unlabelled", "ids"])

    return run


def score(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    A null text scores as an empty one, which has the bias alone. Rows that repeat an id are
    scored each; a null id stays null and counts as held out. Other columns are not read.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scored(model: Lexicon):
    def run(batches):
        for batch in sliced(batches):
            scores = pa.array([model.score(t) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    return run


def remove_toxic(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Null and empty texts score as the empty one; repeated rows stay or go together.
    """
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in sliced(batches):
            keep = [model.score(t or "") < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
