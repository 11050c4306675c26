"""Made vectors: clusters around centres, queries of the same mixture, and vectors that are a function of their id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clusters(spark: SparkSession, n: int, dim: int, centres: int = 50, spread: float = 5.0, seed: int = 0, first: int = 0) -> DataFrame:
    """(vec_id, label, embedding): unit noise around centres whose coordinates are spread standard normals. Ids begin with
    first, so rows beyond n are of the same mixture and serve as queries."""
    middle = np.random.default_rng(seed).standard_normal((centres, dim)) * spread

    def made(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            own = [np.random.default_rng((seed, int(i))) for i in ids]
            label = np.array([r.integers(centres) for r in own], np.int32)
            rows = [middle[k] + r.standard_normal(dim) for k, r in zip(label, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label), pa.array([x.astype(np.float32) for x in rows], pa.list_(pa.float32()))], ["vec_id", "label", "embedding"])

    return spark.range(first, first + n).mapInArrow(made, "vec_id long, label int, embedding array<float>")


#: The factors of the id and of the place in made vectors, modulo 2 ** 64, and the bits that are dropped.
BY_ID, BY_PLACE, DROPPED = 6364136223846793005, 1442695040888963407, 33


def vectors_of(ids: np.ndarray, dim: int) -> np.ndarray:
    """A row of 32-bit floats for each id, a function of the id alone: what is left of the product over 2 ** 32 - 1, less a half."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(BY_ID) + (np.arange(dim, dtype=np.uint64) * np.uint64(BY_PLACE))[None]
    return (x >> np.uint64(DROPPED)).astype(np.float32) / np.float32(2**32 - 1) - np.float32(0.5)


def by_id(ids: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding) of vectors_of."""

    def made(batches):
        for batch in batches:
            v = vectors_of(batch.column("vec_id").to_numpy(zero_copy_only=False), dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "embedding"])

    return ids.select(F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(made, "vec_id long, embedding array<float>")
