"""Approximate nearest neighbours by cosine: probed lists, scanned dimension block by block.

Vectors are put in lists around centres fitted on a bounded sample. A query looks into the
lists with the nearest centres; how many, the sample decides: the fewest with which sampled
queries find their neighbours, and more where those hold too few candidates. Within a list the unit vectors are turned by one random
rotation, so that any leading columns estimate the whole distance, and are read in column
blocks. After each block a test at a set confidence gives up candidates whose distance,
scaled up from the columns read, already lies beyond the query's worst kept one. What is
left is scored exactly on the original vectors.

Equal vectors are one candidate with its smallest ids; a list is cut into blocks of bounded
size, and so are the queries of a list, each pair of blocks being a task's group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_parts, written

#: Vectors in the sample that fits centres and probes; lists at most.
SAMPLE, MAX_LISTS = 8_000, 1_024
#: Share of the sample's true neighbours that the chosen number of probes finds.
TARGET = 0.98
#: Candidates, and queries, of a group.
BLOCK, QUERIES = 4_096, 512
#: Columns read between two tests, the tests' width in deviations, and rows between two bounds.
COLUMNS, WIDTH, STRETCH = 16, 2.1, 1_024


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding"))
        .filter("vec_id is not null and embedding is not null").filter(finite & F.exists(v, lambda x: x != 0))
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _stack(column) -> np.ndarray:
    """Vectors, each brought near one by a power of two: no cosine changes, and no square overflows or vanishes."""
    rows = np.stack([np.asarray(x, np.float64) for x in column])
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True, initial=0))[1])


class Lists:
    """Centres, and how many of them a query probes."""

    def __init__(self, sample: np.ndarray, n: int, k: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        units = _unit(sample) if len(sample) else sample
        lists = int(np.clip(round(n**0.5 / 2), 1, min(MAX_LISTS, max(1, len(sample) // 8))))
        centres = units[rng.choice(len(units), lists, replace=False)] if len(units) else np.zeros((1, 1))
        for _ in range(8 if len(units) else 0):
            own = (units @ centres.T).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, own, units)
            filled = np.bincount(own, minlength=lists) > 0
            centres[filled] = total[filled] / np.maximum(np.sqrt((total[filled] ** 2).sum(1, keepdims=True)), 1e-12)
        self.centres = centres
        self.probes = self._enough(units, k, rng)

    def _enough(self, units: np.ndarray, k: int, rng) -> int:
        lists = len(self.centres)
        if len(units) <= k:
            return lists
        own = (units @ self.centres.T).argmax(1)
        asked = rng.choice(len(units), min(300, len(units)), replace=False)
        near = units[asked] @ units.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-(units[asked] @ self.centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(asked), 0), axis=1)
        needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(min(lists, needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)] + 1))

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """All lists of each row, the one with the nearest centre first."""
        return np.argsort(-(_unit(rows) @ self.centres.T), axis=1, kind="stable")

    def probed(self, rows: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each row looks into: ``probes`` of them, or as many more as hold ``least``
        candidates (``held`` by list), or all."""
        order = self.nearest(rows)
        enough = (np.cumsum(held[order], axis=1) < least).sum(1) + 1
        return [o[: max(self.probes, n)] for o, n in zip(order, enough, strict=True)]


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` whose id is
    divisible by ``every``, its ``k`` nearest other rows found.

    Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do null
    ids; vectors of different lengths are searched apart. A repeated id is a candidate each
    time with another vector, and never its own neighbour. Other columns are not read.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    limit = W.partitionBy("digest").orderBy("vec_id")
    rows = usable.select("vec_id", "embedding", F.size("embedding").alias("d"), F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256).alias("digest"))
    # of equal vectors the k + 1 smallest ids can be among the nearest of anything
    least = rows.distinct().withColumn("r", F.row_number().over(limit)).filter(F.col("r") <= k + 1)
    distinct = written(least.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"), F.first("d").alias("d")))
    asked = written(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "digest", "d").distinct())
    out = None
    for d in sorted(r["d"] for r in distinct.select("d").distinct().collect()):  # lengths of vectors: one, as a rule
        found = _search_one(spark, distinct.filter(F.col("d") == d), asked.filter(F.col("d") == d), k, d)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search_one(spark, distinct: DataFrame, asked: DataFrame, k: int, d: int) -> DataFrame:
    n = distinct.count()
    kind = distinct.schema["embedding"].dataType.simpleString()
    sample = distinct.orderBy("digest").limit(SAMPLE).select("embedding").collect()
    lists = Lists(_stack(r[0] for r in sample), n, k)
    shape = f"digest string, ids array<long>, embedding {kind}, list int"
    candidates = written(distinct.select("digest", "ids", "embedding").mapInPandas(_assigned(lists), shape))
    held = np.zeros(len(lists.centres), np.int64)  # MAX_LISTS numbers at most
    for r in candidates.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["list"]] = r["n"]
    wanted = asked.select("digest").distinct()
    own = candidates.select("digest", "embedding").join(wanted, "digest", "left_semi")
    probing = own.withColumn("ids", F.lit(None).cast("array<long>")).select("digest", "ids", "embedding")
    queries = written(probing.mapInPandas(_assigned(lists, held, k + 1), shape))
    sizes = candidates.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    loads = queries.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("loads"))
    plan = F.broadcast(sizes.join(loads, "list"))  # a row for each list, MAX_LISTS at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = candidates.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("load", each("loads")).select("list", "block", "load", "digest", "ids", "embedding")
    right = queries.join(plan, "list").withColumn("load", F.pmod(F.xxhash64("digest"), F.col("loads")).cast("int")).withColumn("block", each("blocks")).select("list", "block", "load", F.col("digest").alias("query"), "embedding")
    key = ["list", "block", "load"]
    near = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(_scan(k, d), "query string, ids array<long>, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    top = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("query", "ids", "score")
    # equal queries share their candidates; each leaves out itself
    lists_of = top.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    one = asked.join(lists_of, F.col("digest") == F.col("query")).select(
        F.col("vec_id").alias("query_id"),
        F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("i"))))).alias("all"),
    )
    mine = F.slice(F.array_sort(F.filter("all", lambda x: x["i"] != F.col("query_id"))), 1, k)
    return one.select("query_id", F.posexplode(mine).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _assigned(lists: Lists, held: np.ndarray | None = None, least: int = 0):
    """Rows in their nearest list or, with ``held`` given, in every list that they probe."""

    def run(batches):
        for rows in batches:
            if len(rows):
                vectors = _stack(rows["embedding"])
                found = lists.nearest(vectors)[:, :1] if held is None else lists.probed(vectors, held, least)
                at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
                yield rows.iloc[at].assign(list=np.concatenate(list(found)).astype(np.int32))

    return run


def rotation(d: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def scan(units: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Rows of the rotated ``units`` that may be among the ``k`` nearest of the rotated ``query``.

    Rows come in stretches. Squared distances grow column block by column block; from the ``c``
    columns read the whole is estimated as ``d / c`` times, and a row is given up when that
    exceeds the worst kept distance by more than ``WIDTH / sqrt(c)`` of it. After each stretch
    the worst kept distance is that of the ``k`` best so far.
    """
    d = units.shape[1]
    kept, distance, bound = np.empty(0, np.int64), np.empty(0), np.inf
    first = 0
    while first < len(units):
        last = min(len(units), first + (STRETCH if first else 4 * k))
        alive, partial = np.arange(first, last), np.zeros(last - first)
        for c in range(0, d, COLUMNS):
            part = units[alive, c : c + COLUMNS] - query[c : c + COLUMNS]
            partial = partial + (part * part).sum(1)
            read = min(d, c + COLUMNS)
            if read < d:
                keep = partial * (d / read) <= bound * (1 + WIDTH / read**0.5) ** 2 + 1e-9
                alive, partial = alive[keep], partial[keep]
        kept, distance = np.concatenate([kept, alive]), np.concatenate([distance, partial])
        if len(kept) > k:
            bound = np.partition(distance, k - 1)[k - 1]
            near = distance <= bound + 1e-9
            kept, distance = kept[near], distance[near]
        first = last
    return kept


def _scan(k: int, d: int):
    turn = rotation(d)

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values("digest")
            v, q = _stack(candidates["embedding"]), _stack(queries["embedding"])
            ids = [list(map(int, x)) for x in candidates["ids"]]
            first = np.array([x[0] for x in ids])
            v_norm, q_norm = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
            v_turned, q_turned = _unit(v) @ turn, _unit(q) @ turn
            for name, x, norm, turned in zip(queries["query"], q, q_norm, q_turned, strict=True):
                at = scan(v_turned, turned, k + 1)
                score = (v[at] * x).sum(1) / (v_norm[at] * norm)
                order = np.lexsort((first[at], -score))[: k + 1]
                found += [(name, ids[at[o]], float(score[o])) for o in order]
        return pd.DataFrame(found, columns=["query", "ids", "score"])

    return run
