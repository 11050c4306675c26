"""What the operators of this subpackage share: working folders, code shipping, skew-safe joins."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a Python worker gets at a time (one row at least), and of text that it works on at once.
ARROW_BYTES, BATCH_BYTES = 8 << 20, 4 << 20
#: A group with at least one in HOT_SHARE rows is hot; so there are at most HOT_SHARE hot groups.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset, under a local folder if driver and executors are
    one process (tests), and else an error: executors couldn't read a folder of the driver's."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            top = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            top = tempfile.mkdtemp(prefix="sparkvec-")
            spark.sparkContext.setCheckpointDir(top)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared store."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each write inside go as soon as it has ended; else they stay until the driver happens to collect
    its garbage. For frames that are executed once, as others would be shuffled anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Tables staged for one job, each deleted once its last reader is through: drop() names those; at the end of the with
    block all that keep() doesn't name go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)  # the frame is held, so its id stays its own
        return out

    def drop(self, *frames: DataFrame) -> None:
        removed(self.spark, *(self.paths.pop(id(f))[0] for f in frames))

    def keep(self, *frames: DataFrame) -> None:
        for f in frames:
            self.paths.pop(id(f))

    def __exit__(self, *failure) -> None:
        self.drop(*(f for _, f in list(self.paths.values())))


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that none of names is, in any case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once, and bound the Arrow batches that Python workers get by their bytes."""
    context = spark.sparkContext
    if not getattr(context, "_sparkvec_shipped", False):
        package = Path(__file__).resolve().parent.parent
        path = os.path.join(tempfile.mkdtemp(prefix="sparkvec-code-"), "sparkvec-code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(package.rglob("*.py")):
                out.write(p, str(p.relative_to(package.parent)))
        context.addPyFile(path)
        context._sparkvec_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most about that many bytes of text (one row at least). Parts are copies: some Arrow kernels, such as
    ascii_lower, read slices wrongly."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            held = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + most, "right")))
            yield batch if start == 0 and stop >= batch.num_rows else batch.take(pa.array(np.arange(start, min(stop, batch.num_rows))))
            start = stop


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row per key. Groups with at least total / HOT_SHARE rows, of which there are
    at most HOT_SHARE, are broadcast, so that no key of the shuffled rest is hot."""
    least = max(2, -(-total // HOT_SHARE))
    added = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) >= least).withColumn("_hot", F.lit(True))
    first = rows.join(F.broadcast(hot), key, "left")
    done = first.where(F.col("_hot")).drop("_hot")
    rest = first.where(F.col("_hot").isNull()).drop("_hot", *added)
    return done.unionByName(rest.join(groups.where(F.col(size) < least), key, "left"))
