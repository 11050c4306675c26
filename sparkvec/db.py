"""The collection as one object: add, search, search by codes, checkpoint. Matrices are numpy arrays."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.errors import Corrupt, DimensionMismatch, InvalidArgument
from sparkvec.functions.distance import metric as metric_of
from sparkvec.operators import hnsw, knn, pq
from sparkvec.sources.store import VectorStore

#: Rows of a shard's graph at most; shards are runs of ids, so an add changes the last one only.
SHARD_ROWS = 20_000
NO_ID = np.uint64(2**64 - 1)


class VectorDb:
    """A collection in a folder. Every add is durable when it returns, whatever durable is: batches and manifests are files
    of the shared store, which has no weaker mode. Stored settings win over those given."""

    def __init__(self, spark: SparkSession, path: str, dim: int, m: int = 16, ef_construction: int = 200, metric: str = "l2", durable: bool = True):
        metric_of(metric)
        hnsw.HnswConfig(m, ef_construction, metric)
        if VectorStore.exists(spark, path):
            self.store = VectorStore.open(spark, path, dim)
        else:
            self.store = VectorStore.create(spark, path, dim, m=m, ef_construction=ef_construction, metric=metric)
        s = self.store.state["settings"]  # what was stored wins
        self.config = hnsw.HnswConfig(s["m"], s["ef_construction"], s["metric"])
        self.spark, self.path = spark, path
        self.codebook: DataFrame | None = None
        if s.get("codebook"):
            self.codebook = spark.read.schema(pq.CODEBOOK).parquet(f"{path}/{s['codebook']}")

    def __len__(self) -> int:
        return self.store.state["rows"]

    @property
    def dim(self) -> int:
        return self.store.state["dim"]

    @property
    def shards(self) -> int:
        return max(1, -(-len(self) // SHARD_ROWS))

    def add(self, vectors: np.ndarray) -> int:
        v = np.asarray(vectors, np.float32)
        if v.ndim == 1 and len(v) % self.dim:
            raise InvalidArgument("the number of values isn't a multiple of the dimension")
        v = v.reshape(-1, self.dim) if v.ndim == 1 else v
        if v.ndim != 2 or v.shape[1] != self.dim:
            raise DimensionMismatch(f"vectors must have {self.dim} dimensions")
        rows = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, embedding array<float>")
        return self.store.append(rows)

    def get(self, vec_id: int) -> np.ndarray:
        return np.array(self.store.get(vec_id), np.float32)

    def _written(self, name: str, frame: DataFrame) -> str:
        import uuid

        folder = f"{name}-{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/{folder}")
        return folder

    def _settle(self, **settings) -> None:
        self.store._publish(dict(self.store.state, settings=self.store.state["settings"] | settings))

    def _parts(self, name: str, schema: str) -> list[DataFrame]:
        """The frames of a table that is stored in parts, each counting up to the next one's first key."""
        parts = self.store.state["settings"].get(name, {}).get("parts", [])
        key = "shard" if name == "graph" else "vec_id"
        ends = [p["first"] for p in parts[1:]] + [1 << 62]
        return [self.spark.read.schema(schema).parquet(f"{self.path}/{p['folder']}").where(F.col(key) < end) for p, end in zip(parts, ends, strict=True)]

    def _extended(self, name: str, schema: str, first: int, make) -> DataFrame:
        """The table, once a part from key first on is made where rows were added since the last one."""
        known = self.store.state["settings"].get(name, {"rows": 0, "parts": []})
        if known["rows"] != len(self) or not known["parts"]:
            kept = [p for p in known["parts"] if p["first"] < first]
            self._settle(**{name: {"rows": len(self), "parts": [*kept, {"first": first, "folder": self._written(name, make())}]}})
        return functools.reduce(DataFrame.unionByName, self._parts(name, schema))

    def _graph(self) -> DataFrame:
        """The edges. Shards that are full stay as they are; those that rows were added to are built anew."""
        first = self.store.state["settings"].get("graph", {"rows": 0})["rows"] // SHARD_ROWS
        new = self.store.frame().where(F.col("vec_id") >= first * SHARD_ROWS)
        return self._extended("graph", hnsw.EDGES, first, lambda: hnsw.build(new, self.config, self.shards, SHARD_ROWS))

    def _codes(self) -> DataFrame:
        """The stored codes. Only vectors that have none are encoded."""
        first = self.store.state["settings"].get("codes", {"rows": 0})["rows"]
        new = self.store.frame().where(F.col("vec_id") >= first)
        return self._extended("codes", "vec_id long, codes array<int>", first, lambda: pq.encode(new, self.codebook, self._width()))

    def _width(self) -> int:
        return len(self.codebook.first()["centroid"])

    def _queries(self, queries: np.ndarray) -> tuple[np.ndarray, DataFrame]:
        q = np.asarray(queries, np.float32)
        if q.ndim != 2 or q.shape[1] != self.dim:
            raise DimensionMismatch(f"queries must have {self.dim} columns")
        return q, self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, q array<float>")

    def _matrices(self, found: DataFrame, nq: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, d = np.full((nq, k), NO_ID), np.full((nq, k), np.inf, np.float32)
        for r in found.collect():  # nq * k rows
            ids[r["qid"], r["rank"] - 1], d[r["qid"], r["rank"] - 1] = r["vec_id"], r["distance"]
        return ids, d

    def search(self, queries: np.ndarray, k: int, ef: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), nq by k; rows short of neighbours end in NO_ID and infinity."""
        q, frame = self._queries(queries)
        if not k or not len(self):
            return self._matrices(self.spark.createDataFrame([], "qid long, rank long, vec_id long, distance double"), len(q), k)
        return self._matrices(hnsw.search(self.store.frame(), self._graph(), frame, k, ef, self.config, self.shards, span=SHARD_ROWS), len(q), k)

    def search_exact(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        q, frame = self._queries(queries)
        return self._matrices(knn.knn(self.store.frame(), frame, k, self.config.metric), len(q), k)

    def train_pq(self, m: int = 16, iters: int = 25, max_samples: int = 100_000) -> None:
        folder = self._written("codebook", pq.train(self.store.frame(), self.dim, m, iters, max_samples, by=self.config.metric))
        self._settle(codebook=folder, codes={"rows": 0, "parts": []})
        self.codebook = self.spark.read.schema(pq.CODEBOOK).parquet(f"{self.path}/{folder}")

    def pq_inconsistent_ids(self) -> tuple[list[int], int, int]:
        """(ids whose stored code is missing or not what encoding anew gives, codes stored, vectors stored)."""
        if self.codebook is None:
            raise Corrupt("product quantization hasn't been trained")
        parts = self._parts("codes", "vec_id long, codes array<int>")
        codes = functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "vec_id long, codes array<int>")
        bad = pq.inconsistent(codes, self.store.frame(), self.codebook, self._width())
        return sorted(r["vec_id"] for r in bad.collect()), codes.count(), len(self)

    def search_pq(self, queries: np.ndarray, k: int, ef: int = 64, rerank: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Walks by the distances of codes; rerank = 0 returns those, else k * rerank candidates are measured exactly."""
        q, frame = self._queries(queries)
        if not k:
            return np.zeros((len(q), 0), np.uint64), np.zeros((len(q), 0), np.float32)
        if self.codebook is None:
            raise Corrupt("product quantization hasn't been trained")
        if k * max(rerank, 1) >= 2**63:
            raise InvalidArgument("k * rerank is too large")
        n = k * max(rerank, 1)
        found = hnsw.search(self.store.frame(), self._graph(), frame, n, max(ef, n), self.config, self.shards, self._codes(), pq.book_of(self.codebook), SHARD_ROWS)
        if rerank:
            found = pq.reranked(found, self.store.frame(), frame, k)
        return self._matrices(found.where(F.col("rank") <= k), len(q), k)

    def checkpoint(self) -> None:
        self.store.compact()
        if len(self):
            self._graph()
            if self.codebook is not None:
                self._codes()

    def verify(self) -> None:
        """Raises where a batch or the graph isn't what it should be."""
        self.store.verify()
        if len(self):
            edges = self._graph()
            nodes = edges.where("layer = 0").agg(F.count(F.lit(1)), F.countDistinct("node_id"), F.min("node_id"), F.max("node_id")).first()
            if tuple(hnsw.violations(edges, self.config.m).first()) != (0, 0, 0) or tuple(nodes) != (len(self), len(self), 0, len(self) - 1):
                raise Corrupt("the graph is damaged")

    def orphan_count(self) -> int:
        edges = self._graph()
        return hnsw.orphans(edges, hnsw.entries(edges)).count()
