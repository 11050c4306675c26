"""A vector collection as a folder of Parquet batches with a JSON manifest that names those which count.

A batch is written first and then named in a new manifest, which has the next number; a batch that no manifest names
doesn't exist. A manifest is never changed or replaced: it is made under a name that must not exist, so of two writers one
fails, and it holds its own checksum, so one that a crash left incomplete doesn't count and the one before is the newest.
Ids are dense, in append order. The manifest also holds the settings the collection was made with, which win over a later
caller's, and the last streaming batch that was taken.
"""

from __future__ import annotations

import json
import uuid
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkvec.errors import Corrupt, DimensionMismatch, IdOutOfRange, InvalidArgument
from sparkvec.plans.saved import saved

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])
PREFIX, VERSION, KEPT = "manifest-", 1, 8


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def _names(cls, spark: SparkSession, path: str) -> list[str]:
        where, fs = cls._fs(spark, path)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        """Whether anything of a collection is in a folder, a manifest or not."""
        return any(n.startswith((PREFIX, "batch-")) for n in cls._names(spark, path))

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, **settings) -> VectorStore:
        if not 1 <= dim < 2**32:
            raise InvalidArgument("dim must be from 1 to 2**32 - 1")
        if cls.exists(spark, path):
            raise Corrupt(f"{path} already holds a collection, or what is left of one")
        store = cls(spark, path, {"version": VERSION, "number": 0, "dim": dim, "rows": 0, "batches": [], "last_batch": -1, "settings": settings})
        store._publish(store.state)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int | None = None) -> VectorStore:
        """The newest whole manifest's state."""
        found = [n for n in cls._names(spark, path) if n.startswith(PREFIX)]
        if not found:
            raise Corrupt(f"{path} has no manifest")
        state = next((x for n in reversed(found) if (x := cls._state(spark, f"{path}/{n}"))), None)
        if state is None:
            raise Corrupt(f"no manifest of {path} is whole")
        if state.get("version") != VERSION or state["rows"] != sum(b["rows"] for b in state["batches"]):
            raise Corrupt(f"the manifest of {path} contradicts itself")
        if dim is not None and dim != state["dim"]:
            raise DimensionMismatch(f"the collection has {state['dim']} dimensions, not {dim}")
        return cls(spark, path, state)

    @staticmethod
    def _state(spark: SparkSession, file: str) -> dict | None:
        """A manifest's state; nothing where its writing was cut short, an error where it is damaged."""
        try:
            text = spark.read.text(file, wholetext=True).collect()
        except Exception as e:
            raise Corrupt(f"{file} can't be read") from e
        head, _, body = (text[0][0] if text else "").partition("\n")
        size, _, crc = head.partition(" ")
        if not (size.isdigit() and crc.isdigit()) or len(body) < int(size):
            return None
        if zlib.crc32(body.encode()) != int(crc):
            raise Corrupt(f"{file} is damaged")
        return json.loads(body)

    def _publish(self, state: dict) -> None:
        """Make state the newest, or fail where another writer has been faster."""
        taken = [int(n.removeprefix(PREFIX)) for n in self._names(self.spark, self.path) if n.startswith(PREFIX)]
        newest = max((n for n in taken if self._state(self.spark, self._manifest(n))), default=0)
        if newest > self.state["number"]:
            raise Corrupt(f"another writer has changed {self.path}")
        state = dict(state, number=max(taken, default=0) + 1)
        body = json.dumps(state)
        target, fs = self._fs(self.spark, self._manifest(state["number"]))
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            raise Corrupt(f"another writer has changed {self.path}") from e
        out.write(bytearray(f"{len(body)} {zlib.crc32(body.encode())}\n{body}".encode()))
        out.close()
        self.state = state
        for n in sorted(taken)[:-KEPT]:
            fs.delete(self._fs(self.spark, self._manifest(n))[0], False)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/{PREFIX}{number:012d}"

    def verify(self) -> None:
        """Raises where a batch can't be read whole, or hasn't the rows, ids and widths that it should."""
        for b in self.state["batches"]:
            try:
                own = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{b['name']}")
                wide = F.sum((F.size("embedding") != self.state["dim"]).cast("long")).alias("wide")
                r = own.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.countDistinct("vec_id").alias("ids"), wide).first()
            except Exception as e:
                raise Corrupt(f"{b['name']} can't be read") from e
            if r["n"] != b["rows"] or r["n"] and (r["first"], r["last"], r["ids"], r["wide"]) != (b["first"], b["first"] + b["rows"] - 1, b["rows"], 0):
                raise Corrupt(f"{b['name']} isn't what the manifest says")

    def frame(self) -> DataFrame:
        """All vectors; only batches in the manifest are read."""
        paths = [f"{self.path}/{b['name']}" for b in self.state["batches"]]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Append rows (embedding, and ord to order them by), all or none; the first id. A streaming batch already taken is skipped."""
        first = self.state["rows"]
        if batch is not None and batch <= self.state["last_batch"]:
            return first
        name = f"batch-{uuid.uuid4().hex}"
        width = F.when(F.size("embedding") == self.state["dim"], F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit("DimensionMismatch")).cast("array<float>"))
        try:
            assign_ids(rows.withColumn("embedding", width), "ord", first).select("vec_id", "embedding").write.parquet(f"{self.path}/{name}")
        except Exception as e:
            if "DimensionMismatch" in str(e):
                raise DimensionMismatch(f"vectors must have {self.state['dim']} dimensions") from e
            raise
        n = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").count()
        state = dict(self.state, rows=first + n, batches=[*self.state["batches"], {"name": name, "first": first, "rows": n}])
        self._publish(state | ({"last_batch": batch} if batch is not None else {}))
        return first

    def get(self, vec_id: int) -> list[float]:
        if not 0 <= vec_id < self.state["rows"]:
            raise IdOutOfRange(f"no vector has the id {vec_id}")
        own = next(b for b in self.state["batches"] if b["first"] <= vec_id < b["first"] + b["rows"])
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{own['name']}").where(F.col("vec_id") == vec_id).first()["embedding"]

    def compact(self) -> None:
        """All batches as one, sorted by id."""
        if not self.state["batches"]:
            return
        name = f"batch-{uuid.uuid4().hex}"
        self.frame().sort("vec_id").write.parquet(f"{self.path}/{name}")
        self._publish(dict(self.state, batches=[{"name": name, "first": 0, "rows": self.state["rows"]}]))


def assign_ids(rows: DataFrame, order: str, first: int) -> DataFrame:
    """rows with vec_id = first, first + 1, ... in the order of a column, equal ones by their other columns' hash: counted in
    ranges of it, not in one task. The ranges are written once, so that counts and numbers are of the same rows even if
    the input isn't the same when it is read again."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    ranged = saved(rows.withColumn("_tie", tie).repartitionByRange(parts, order, "_tie").withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order, "_tie")) - 1
    numbered = ranged.withColumn("_at", place).join(F.broadcast(before), "_part")
    return numbered.withColumn("vec_id", (F.col("_before") + F.col("_at") + F.lit(first)).cast("long")).drop("_part", "_at", "_before", "_tie")
