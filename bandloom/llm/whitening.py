"""Whitening of embeddings with MLlib's BlockMatrix.

The distinct vectors, centred, are indexed into distributed blocks of rows; the block matrix
times its own transpose is the scatter, one small square that the driver decomposes. All
rows, centred alike, are a second block matrix, which the whitening matrix projects.

The product over rows is split along them (``numMidDimSplits``), so that a task multiplies a
bounded number of blocks and only squares of the vectors' length meet in one place. What the
driver holds are those squares and the numbers of the blocks, one for ``CELLS`` numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cuts, written

#: Cells (2 MB) and columns of a block, and blocks of rows that one task multiplies.
CELLS, COLUMNS, BLOCKS = 1 << 18, 1_024, 16
#: Entries are counted in steps of 1 / STEPS.
STEPS = 256
#: An eigenvalue below this share of the trace, by dimension, is rounding: its component is none.
NOISE = 1e-14

SHAPE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: rows of ``vectors(vec_id, embedding)`` without null or non-finite entries, in whole steps."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter("embedding is not null").filter(finite)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * STEPS).cast("long")).alias("x"))


def indexed(rows: DataFrame, cut: Cuts) -> DataFrame:
    """``rows`` with ``i``, whole numbers from 0 without gaps: the rows of the parts before and the place in the own."""
    placed = cut(rows.withColumn("_k", F.monotonically_increasing_id()))
    part, place = F.shiftright("_k", 33), F.col("_k").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each part
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    return placed.withColumn("_p", part).join(offsets, "_p").withColumn("i", F.col("_o") + place).drop("_k", "_p", "_o")


def block_matrix(rows: DataFrame, centred: Column, n: int, d: int) -> BlockMatrix:
    """Rows ``i`` with the vector ``centred`` as a matrix of ``n`` by ``d``, built without Python workers."""
    vectors = rows.select(F.col("i").alias("index"), array_to_vector(centred).alias("vector"))
    across = min(d, COLUMNS)
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, d).toBlockMatrix(max(1, CELLS // across), across)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose of ``matrix`` times ``matrix``, in tasks of ``BLOCKS`` blocks of rows each."""
    splits = max(1, -(-matrix.numRows() // (matrix.rowsPerBlock * BLOCKS)))
    java, turned = matrix._java_matrix_wrapper, matrix.transpose()._java_matrix_wrapper
    # the number of splits along the rows is an argument in the JVM only
    product = turned.call("multiply", java._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, by: np.ndarray) -> DataFrame:
    """``i, w``: the rows of ``matrix`` times ``by``."""
    side, spark_context = matrix.colsPerBlock, matrix.blocks.context
    blocks = [((k, 0), Matrices.dense(len(part), by.shape[1], part.ravel(order="F"))) for k, at in enumerate(range(0, len(by), side)) if len(part := by[at : at + side])]
    right = BlockMatrix(spark_context.parallelize(blocks, 1), side, by.shape[1])
    rows = callMLlibFunc("getIndexedRows", matrix.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("i"), vector_to_array(F.col("vector")).alias("w"))


def components(square: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance (as columns), their eigenvalues, falling, and their shares of the trace.

    The covariance is ``square / n``. Eigenvalues that are rounding have no component.
    """
    values, vectors = np.linalg.eigh((square + square.T) / 2 / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    total = float(np.trace(square)) / n
    real = values > NOISE * len(square) * total
    return vectors[:, real], values[real], values[real] / total if real.any() else values[real]


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest entry, in absolute value, of the covariance of ``w`` less the identity."""
    means = whitened.agg(*[F.avg(F.col("w")[c]).alias(f"m{c}") for c in range(k)]).first()
    off = lambda c: F.col("w")[c] - means[c]
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    sums = whitened.agg(*[F.sum(off(a) * off(b)).alias(f"s{a}_{b}") for a, b in pairs]).first()
    return max(abs(s / n - (a == b)) for s, (a, b) in zip(sums, pairs, strict=True))


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """Whitened rows of ``vectors(vec_id, embedding)``: one row for each vector and component.

    vec_id, component (from 1, by falling eigenvalue), n (distinct vectors in steps), deviation
    (exact squared distance of ``n`` times the vector from the sum of the distinct ones),
    whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out. Equal vectors count
    once in the fit, and each row is returned, repeated ids and null ids too. Components of
    eigenvalue zero cannot be whitened and are not returned: with one distinct vector, with
    empty vectors or without any the result is empty. Vectors of several lengths are an error,
    and so is a deviation beyond a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    with Cuts(spark) as cut:
        rows = cut(indexed(usable(vectors), cut))
        lengths = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().limit(2).collect()]
        if len(lengths) > 1:
            raise ValueError("the vectors have several lengths")
        if not lengths or not lengths[0]:
            return spark.createDataFrame([], SHAPE)
        d = lengths[0]
        fit = cut(indexed(rows.select("x").distinct(), cut))
        n, every = fit.count(), rows.count()
        sums = dict(fit.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("x")).collect())  # a number for each dimension
        total = [sums[k] for k in range(d)]
        mean = F.lit([s / n for s in total])
        centred = F.zip_with("x", mean, lambda x, m: x - m)
        matrix = block_matrix(fit, centred, n, d)
        vectors_, values, shares = components(scatter(matrix), n, most)
        k = len(values)
        if not k:
            return spark.createDataFrame([], SHAPE)
        by = vectors_ / np.sqrt(values)
        error = identity_error(cut(projected(matrix, by)), n, k)
        terms = F.zip_with("x", F.lit(total).cast("array<bigint>"), lambda x, s: (x * n - s) * (x * n - s))
        deviation = F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)
        whitened = rows.select("i", "vec_id", deviation.alias("deviation")).join(projected(block_matrix(rows, centred, every, d), by), "i")
        each = whitened.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
        return written(
            each.select(
                "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                F.lit([float(s) for s in shares])[F.col("c")].alias("explained"), F.lit(float(error)).alias("identity_error"),
            )
        )
