"""Readers of .fvecs and .ivecs files: records of a little-endian 32-bit length and as many 32-bit values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(vec_id, embedding array<float>) of .fvecs or (vec_id, ids array<long>) of .ivecs files. Ids count the records of
    a file; with several files, records of each count from 0, told apart by the column path. Varying lengths are an error."""
    if kind not in ("fvecs", "ivecs"):
        raise ValueError("kind must be fvecs or ivecs")
    column, element = ("embedding", "float") if kind == "fvecs" else ("ids", "long")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                words = np.frombuffer(content.as_buffer(), "<i4")
                if not len(words):
                    continue
                dim = int(words[0])
                if dim <= 0 or len(words) % (dim + 1) or (words.reshape(-1, dim + 1)[:, 0] != dim).any():
                    raise ValueError(f"{name}: records of different lengths")
                body = np.ascontiguousarray(words.reshape(-1, dim + 1)[:, 1:])
                values = body.view("<f4") if kind == "fvecs" else body.astype(np.int64)
                for at in range(0, len(values), 10_000):
                    own = values[at : at + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dim, pa.int32()), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(np.arange(at, at + len(own))), lists], ["path", "vec_id", column])

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return files.mapInArrow(parsed, f"path string, vec_id long, {column} array<{element}>")


def load_sift(spark: SparkSession, folder: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, queries, truth) of a folder with sift_base.fvecs, sift_query.fvecs and sift_groundtruth.ivecs: frames
    (vec_id, embedding), (qid, q) and (qid, rank, vec_id). With a limit only that many vectors are read from the base; the
    truth then isn't that of the rest and must be searched anew."""
    base = read_vecs(spark, f"{folder}/sift_base.fvecs").select("vec_id", "embedding")
    queries = read_vecs(spark, f"{folder}/sift_query.fvecs").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    truth = read_vecs(spark, f"{folder}/sift_groundtruth.ivecs", "ivecs").select(F.col("vec_id").alias("qid"), F.posexplode("ids").alias("rank", "id"))
    truth = truth.select("qid", (F.col("rank") + 1).cast("long").alias("rank"), F.col("id").alias("vec_id"))
    return base if limit is None else base.where(F.col("vec_id") < limit), queries, truth
