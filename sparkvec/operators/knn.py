"""Exact nearest neighbours. Frames hold vectors (vec_id long, embedding array<float>) and queries (qid long, q array<float>)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvec.errors import DimensionMismatch, InvalidArgument
from sparkvec.functions.distance import metric, same_length
from sparkvec.plans.saved import saved

#: Queries sent to the executors at once, and rows of vectors that a worker scores at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
#: Neighbours of a query up to which each task keeps its own nearest; for more, tasks get all vectors and share the queries.
FEW = 1024
#: Queries for which a copy of the vectors is made at least, bytes of it that a task holds in memory (more go to a file),
#: distances that it holds at once (those of one query at least), and rows that it sends at once.
QUERIES_A_COPY, HELD, SCORED, SENT = 32, 64 << 20, 4 << 20, 1 << 16
NEIGHBORS = "qid long, vec_id long, distance double"
RANKED = "qid long, rank long, vec_id long, distance double"


def nearest(vectors: DataFrame, q: list[float], k: int, by: str = "l2") -> DataFrame:
    """(vec_id, distance) of the k nearest to one query: a bounded top-k in each task, then one of theirs."""
    own = F.array(*[F.lit(float(x)) for x in q])
    return vectors.where(same_length(own, F.col("embedding"))).select("vec_id", metric(by)(own, F.col("embedding")).alias("distance")).orderBy("distance", "vec_id").limit(k)


def fold(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis from left to right, as a sequential fold gives them."""
    return np.add.accumulate(x, axis=-1)[..., -1] if x.shape[-1] else np.zeros(x.shape[:-1])


def exact_distances(q: np.ndarray, v: np.ndarray, by: str) -> np.ndarray:
    """Distances of one query to rows of v, with the folds of the column expressions."""
    if by == "l2":
        return fold((q - v) ** 2)
    if by in ("ip", "dot"):
        return -fold(q * v) + 0.0
    norms = np.sqrt(fold(np.broadcast_to(q * q, v.shape)) * fold(v * v))
    return np.where(norms == 0, 1.0, 1 - fold(q * v) / np.where(norms == 0, 1, norms))


def rough_distances(q: np.ndarray, v: np.ndarray, by: str) -> np.ndarray:
    """All distances by one matrix product; equal to the exact ones up to rounding."""
    dots = q @ v.T
    if by == "l2":
        return (q * q).sum(1)[:, None] - 2 * dots + (v * v).sum(1)[None]
    if by in ("ip", "dot"):
        return -dots
    norms = np.sqrt((q * q).sum(1)[:, None] * (v * v).sum(1)[None])
    return np.where(norms == 0, 1.0, 1 - dots / np.where(norms == 0, 1, norms))


def _ranked(k: int, by: str):
    """Ranks all vectors for each query of a partition, which has every vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, queries, width, kind = [], [], [], None, np.float64
        with tempfile.SpooledTemporaryFile(HELD) as held:
            for batch in batches:
                for asked, part in ((a, batch.filter(pc.equal(batch.column("asked"), a))) for a in (False, True)):
                    if part.num_rows:
                        kind = np.float32 if pa.types.is_float32(part.column("embedding").type.value_type) else np.float64
                        x = matrix(part.column("embedding"), width)
                        width = x.shape[1]
                        (ids if asked else own).append(part.column("id").to_numpy(zero_copy_only=False))
                        if asked:
                            queries.append(x)
                        else:
                            held.write(x.astype(kind).tobytes())
            if not own or not ids:
                return
            own, ids, queries = (np.concatenate(x) for x in (own, ids, queries))
            by_id, order = np.argsort(own, kind="stable"), np.argsort(ids, kind="stable")
            own, ids, queries, n = own[by_id], ids[order], queries[order], len(own)
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist()  # rows of one query id are ranked together
            ends, some = [*begins[1:], len(ids)], max(1, SCORED // n)
            for first in range(0, len(begins), some):
                low, high = begins[first], ends[min(first + some, len(ends)) - 1]
                d = np.empty((high - low, n))
                held.seek(0)
                for at in range(0, n, ROW_BLOCK):
                    rows = min(ROW_BLOCK, n - at)
                    v = np.frombuffer(held.read(rows * width * np.dtype(kind).itemsize), kind).reshape(rows, width).astype(np.float64)
                    for i in range(low, high):
                        d[i - low, at : at + rows] = exact_distances(queries[i], v, by)
                for a, b in zip(begins[first : first + some], ends[first : first + some], strict=True):
                    each, names = d[a - low : b - low, by_id].T.ravel(), np.repeat(own, b - a)
                    best = np.argsort(each, kind="stable")[:k]
                    for at in range(0, len(best), SENT):
                        near = best[at : at + SENT]
                        columns = np.full(len(near), ids[a]), np.arange(at + 1, at + 1 + len(near)), names[near], each[near]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["qid", "rank", "vec_id", "distance"])

    return run


def ranked(vectors: DataFrame, queries: DataFrame, k: int, by: str) -> DataFrame:
    """What knn gives, for k that may reach the number of vectors. Only copies of the vectors are shuffled, at most two a
    core and one for each QUERIES_A_COPY queries; a task holds the distances of a query to all vectors."""
    copies = min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // QUERIES_A_COPY))
    if not copies:
        return queries.sparkSession.createDataFrame([], RANKED)
    v = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(False).alias("asked"), F.col("vec_id").alias("id"), "embedding")
    q = queries.select(F.pmod(F.xxhash64("qid"), F.lit(copies)).cast("int").alias("copy"), F.lit(True).alias("asked"), F.col("qid").alias("id"), F.col("q").alias("embedding"))
    return v.unionByName(q).repartitionById(copies, "copy").mapInArrow(_ranked(k, by), RANKED)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """An array<float> column as a matrix of doubles; an error where a length isn't width, or not that of the first."""
    n = len(column)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    width = width if width is not None else int(sizes[0]) if n else 0
    if (sizes != width).any():
        raise DimensionMismatch(f"vectors must have {width} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)


def _scan(ids: np.ndarray, queries: np.ndarray, k: int, by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(at, ROW_BLOCK)
                v, own = matrix(batch.column("embedding"), queries.shape[1]), batch.column("vec_id").to_numpy(zero_copy_only=False)
                rough = rough_distances(queries, v, by)
                slack = 1e-9 * (1 + np.abs(rough).max())
                cut = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack if len(own) > k else np.full(len(ids), np.inf)
                for i in range(len(ids)):
                    near = np.flatnonzero(rough[i] <= cut[i])
                    d = np.concatenate([best[i][0], exact_distances(queries[i], v[near], by)])
                    o = np.concatenate([best[i][1], own[near]])
                    keep = np.lexsort((o, d))[:k]
                    best[i] = d[keep], o[keep]
        sizes = [len(d) for d, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([o for _, o in best])), pa.array(np.concatenate([d for d, _ in best]))], ["qid", "vec_id", "distance"])

    return run


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries, QUERY_BLOCK at a time."""
    ids, rows = [], []
    for r in queries.select("qid", "q").toLocalIterator():
        ids.append(r["qid"])
        rows.append(r["q"])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def by_block(queries: DataFrame, search: Callable[[np.ndarray, np.ndarray], DataFrame], schema: str) -> DataFrame:
    """What search gives for all queries. One block is left to be run; of several each is run and written before the next
    is read, so the driver holds two blocks at most, however many queries there are."""
    found, held = None, None
    for block in blocks(queries):
        if held is not None:
            own = saved(search(*held), "block")
            found = own if found is None else found.unionByName(own)
        held = block
    if held is None:
        return queries.sparkSession.createDataFrame([], schema)
    return search(*held) if found is None else found.unionByName(saved(search(*held), "block"))


def merge_top(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank from 1, vec_id, distance): the k nearest of what the tasks found, ties by id. Each task sends k rows a query."""
    w = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")


def knn(vectors: DataFrame, queries: DataFrame, k: int, by: str = "l2") -> DataFrame:
    """(qid, rank, vec_id, distance) of the k nearest vectors of every query.

    Queries go out in blocks; each task keeps k vectors a query, so the shuffle holds k rows for each query and task. For
    more than FEW neighbours no pair is shuffled (see ranked).
    """
    metric(by)
    if k < 0:
        raise InvalidArgument("k must not be negative")
    if not k:
        return merge_top(vectors.sparkSession.createDataFrame([], NEIGHBORS), k)
    if k > FEW:
        return ranked(vectors, queries, k, by)
    return by_block(queries, lambda ids, q: merge_top(vectors.select("vec_id", "embedding").mapInArrow(_scan(ids, q, k, by), NEIGHBORS), k), RANKED)


def padded(neighbors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows for each query: null id and infinite distance where there are fewer neighbours."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank")) if k else queries.select("qid", F.lit(1).cast("long").alias("rank")).limit(0)
    return slots.join(neighbors, ["qid", "rank"], "left").select("qid", "rank", "vec_id", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of true neighbours among those found."""
    hits = found.where(F.col("rank") <= k).select("qid", "vec_id").join(truth.where(F.col("rank") <= k).select("qid", "vec_id"), ["qid", "vec_id"], "left_semi")
    n = truth.select("qid").distinct().agg(F.count(F.lit(1)).alias("nq"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(n).select((F.col("hits") / (F.col("nq") * k)).alias("recall"))
