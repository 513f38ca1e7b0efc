"""What the training-data operators share: reading, folding, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session whose master is this very machine may do without the setting: its driver
    and executors are one process. Elsewhere the absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    return _write(df, *partition_by)[0]


def _write(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Cuts:
    """Written tables that only live until the work around them is done.

    ``with Cuts(spark) as cut: ... return written(result)``: what ``cut`` wrote is deleted at
    the end, so the result must itself be written by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = _write(df)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        context = self.spark.sparkContext
        for name in self.paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []

    def __enter__(self) -> Cuts:
        return self

    def __exit__(self, *failure) -> None:
        self.clear()


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``docs``, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, name: str, cut=written) -> DataFrame:
    """``docs`` with a unique long column ``name``: the id, or a number given to each row of a
    stored copy (made by ``cut``) where ids repeat or are missing."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    odd = ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return cut(docs.withColumn(name, F.monotonically_increasing_id()))


def in_training_fold(doc_id: Column) -> Column:
    """Rows from which labels may be learned: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def held_out(doc_id: Column) -> Column:
    return ~F.coalesce(in_training_fold(doc_id), F.lit(True))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches, rows: int = 1024):
    """Arrow batches in slices, so that only a few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_groups(batches, key: str):
    """Tables of whole groups from batches whose rows lie together by the long column ``key``.

    A group is carried over until its last row has come.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(key).to_numpy()
        if kept and (of[0] != of[-1] or kept[-1].column(key)[0].as_py() != of[0]):
            cut = int((of != kept[-1].column(key)[0].as_py()).argmax())
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept, batch, of = [], batch.slice(cut), of[cut:]
        if of[0] != of[-1]:
            cut = len(of) - int((of[::-1] != of[-1]).argmax())
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()
