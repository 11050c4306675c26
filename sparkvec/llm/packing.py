"""Packing token streams into windows by best-fit decreasing.

A document longer than the window is first cut into full windows. What remains of each document is packed, longest
first, into the open window with the least room that still holds it; a segment tree indexed by remaining room finds it
in log(window) steps. Remainders are dealt by a hash of the id over buckets of bounded size, packed apart from each
other: a bucket costs at most about one window that isn't full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import ship_code, staged, table, text_or_empty
from sparkvec.llm.encoding import encoded

WINDOW = 1024
#: Remainders that one bucket holds on average at most.
BUCKET_ROWS = 200_000
#: Bytes of text that are encoded at once, and words kept: few, as in the pipeline the JVM's heap has grown to its bound
#: before packing begins.
BATCH, KEPT = 2 << 20, 200_000

_PIECES = "doc_id long, uid long, start long, length long, ids_crc32 long, doc_tokens long, full long"


class RoomTree:
    """Counts of open windows by remaining room, in a segment tree: the least room of at least n is found from the leaves up and down."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, room: int) -> int | None:
        i, count = room + self.leaves, self.count
        if count[i]:
            return room
        while i > 1:
            if not i & 1 and count[i + 1]:  # a right neighbour holds larger rooms
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


class BestFit:
    """Windows that are filled one length after the other. place() gives (window number, offset in it)."""

    def __init__(self, window: int):
        self.window, self.tree, self.open, self.n = window, RoomTree(window), {}, 0

    def place(self, length: int) -> tuple[int, int]:
        room = self.tree.tightest(length)
        if room is None:
            at, room = self.n, self.window
            self.n += 1
        else:
            at = self.open[room].pop()
            self.tree.add(room, -1)
        if room > length:
            self.open.setdefault(room - length, []).append(at)
            self.tree.add(room - length, 1)
        return at, self.window - room


def _cut(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        for batch, ids, offsets in encoded(batches, path, end_id, most=BATCH, kept=KEPT):
            rows: list[tuple] = []
            for doc_id, uid, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                n = int(b - a)
                for start in range(0, n, window):
                    piece = ids[a + start : min(a + start + window, b)]
                    full = None
                    if len(piece) == window:
                        full = first + made
                        made += 1
                    rows.append((doc_id, uid, start, len(piece), zlib.crc32(piece), n, full))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def _placed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fit = None, BestFit(window)
        for batch in batches:
            out = []
            for own, length in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != bucket:
                    bucket, fit = own, BestFit(window)
                at, offset = fit.place(length)
                out.append((((own << 33) + at) * 2 + 1, offset))
            keep = [x.split()[0] for x in _PIECES.split(", ")][:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences: doc_id, uid, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text by the vocabulary file at path (null text: empty), then end_id, so each has one
    piece at least. Rows with one id are packed each for itself; uid tells them apart. Null ids stay null. Full windows
    have even sequence ids, packed remainders odd ones. No rows: no pieces.
    """
    spark = docs.sparkSession
    ship_code(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), text_or_empty().alias("text"))
    pieces = staged(own.mapInArrow(_cut(path, end_id, window), _PIECES), "pieces")
    keep = ["doc_id", "uid", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.where("full is not null").select(*keep, (F.col("full") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where("full is null")
    buckets = max(1, -(-rest.count() // BUCKET_ROWS))  # of the remainders alone, so that no setting changes the packing
    dealt = rest.select(*keep, F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket")).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("length"), "doc_id", "uid")
    ddl = ", ".join(f"{c} long" for c in [*keep, "sequence_id", "offset"])
    return whole.unionByName(dealt.mapInArrow(_placed(window), ddl))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0).drop("uid")
