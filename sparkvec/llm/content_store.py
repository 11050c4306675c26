"""Token ids in a content-addressed store.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks where the hash has its low bits at
zero, so equal passages give equal chunks wherever they stand. A chunk's address is the SHA-256 of its bytes; each chunk
is stored once. A document's recipe lists its chunks; recipes are written in ascending id order with the number of ids
before them. A manifest holds a Merkle tree: the leaves are the hashes of recipes (all their columns), a node is the hash
of its children, one subtree a recipe partition, and the root, the hash of the subtrees, covers all. Readers make every
leaf, node and the root anew from the recipes.

Files, all Parquet, below the store's folder:
  chunks/    address binary, n_ids int, width int (bytes an id: 2 or 4, little-endian), payload binary
  recipes/   doc_id, start, n_tokens long, uid long, leaf binary, addresses array<binary>, begins array<long>, sizes array<int>;
             part = range of ids
  manifest/  part int, n_docs, n_tokens long, node binary
  root/      node binary; one row
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvec.llm.common import removed, shared_folder, ship_code, shuffles_dropped, table, text_or_empty
from sparkvec.llm.crc import crc_shift
from sparkvec.llm.encoding import encoded

#: Ids that the rolling hash sees, and the least, mean (a power of two) and most ids of a chunk.
WINDOW, LEAST, MEAN, MOST = 16, 64, 256, 2048
#: Bytes of text that are encoded at once: the more, the fewer words are met again in another batch.
BATCH = 8 << 20
#: Parts by address in which chunks are shuffled, one after another, so that the disk holds a part's shuffle files at once.
SLICES = 4

_CHUNK = pa.struct([("address", pa.binary()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary())])
_NEW = [f"new{s}" for s in range(SLICES)]  # a column for each part, so that a part is read alone
_DDL = "doc_id long, uid long, n_tokens long, addresses array<binary>, begins array<long>, sizes array<int>, " + ", ".join(f"{c} array<struct<address: binary, n_ids: int, width: int, payload: binary>>" for c in _NEW)


def id_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each id (the splitmix64 finalizer)."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def candidates(ids: np.ndarray) -> np.ndarray:
    """The places behind which a chunk may end: each depends on the WINDOW ids before it only, so streams that stand one
    after another can be searched as one, as no chunk ends within LEAST ids of its beginning."""
    h, span = id_hashes(ids), 1
    while span < min(WINDOW, len(ids)):  # h[i] = sum of hash(ids[i - j]) << j over j < span
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    return np.flatnonzero((h >> np.uint64(20)) & np.uint64(MEAN - 1) == 0) + 1


def cut_points(start: int, stop: int, places: np.ndarray) -> list[int]:
    """The ends of the chunks of the stream from start to stop; places are the candidates, in order."""
    if stop - start <= LEAST:
        return [stop] if stop > start else []
    own = places[np.searchsorted(places, start + LEAST) : np.searchsorted(places, stop)].tolist()
    ends, at, k = [], start, 0
    while stop - at > LEAST:
        while k < len(own) and own[k] < at + LEAST:
            k += 1
        at = min(own[k] if k < len(own) else stop, at + MOST, stop)
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


def pack(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return width, ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unpack(width: int, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if width == 2 else "<u4").astype("<u4")


def address(width: int, payload: bytes) -> bytes:
    return hashlib.sha256(b"%d:" % width + payload).digest()


def _lists(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)


def _chunked(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # chunks already sent by this task; begun anew when large
        for batch, ids, offsets in encoded(batches, path, end_id, most=BATCH):
            places, bounds = candidates(ids), offsets.tolist()
            cuts = [cut_points(a, b, places) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            counts = list(map(len, cuts))
            ends = np.array([e for own in cuts for e in own], np.int64)
            starts = np.concatenate([[0], ends[:-1]])  # an id ends each text, so the streams' chunks follow each other
            wide = np.maximum.reduceat(ids, starts) >= 65536
            raw = {2: ids.astype("<u2").tobytes(), 4: ids.tobytes() if wide.any() else b""}
            keys, fresh = [], [[] for _ in _NEW]
            for k, (a, b, w) in enumerate(zip(starts.tolist(), ends.tolist(), np.where(wide, 4, 2).tolist(), strict=True)):
                payload = raw[w][w * a : w * b]
                key = address(w, payload)
                keys.append(key)
                if key not in seen:
                    seen.add(key)
                    fresh[key[0] % SLICES].append((k, w, payload))
            of = np.repeat(np.arange(len(counts)), counts)
            new = []
            for own in fresh:
                news = np.array([k for k, _, _ in own], np.int64)
                columns = [pa.array([keys[k] for k in news], pa.binary()), pa.array((ends - starts)[news], pa.int32()), pa.array([w for _, w, _ in own], pa.int32()), pa.array([p for _, _, p in own], pa.binary())]
                new.append(_lists(np.bincount(of[news], minlength=len(counts)).tolist(), pa.StructArray.from_arrays(columns, fields=list(_CHUNK))))
            lists = [_lists(counts, pa.array(x)) for x in (pa.array(keys, pa.binary()), starts - offsets[:-1][of], pa.array(ends - starts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(np.diff(offsets)), *lists, *new], ["doc_id", "uid", "n_tokens", "addresses", "begins", "sizes", *_NEW])
            if len(seen) > 200_000:
                seen.clear()

    return run


def write_store(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Encode docs (doc_id, text; null text: empty) with the vocabulary file at path and write the store to folder.

    Rows with one id are all stored, in an order of their own. Null ids come first. No rows: empty files.
    """
    spark = docs.sparkSession
    ship_code(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), text_or_empty().alias("text"))
    own.mapInArrow(_chunked(path, end_id), _DDL).write.option("compression", "zstd").parquet(f"{folder}/staged")
    staged = spark.read.schema(_DDL).parquet(f"{folder}/staged")
    with shuffles_dropped(spark):
        for new in _NEW:
            # Each task sends a chunk once, so a sort before the shuffle would find next to nothing.
            chunks = staged.select(F.explode(new).alias("c")).select("c.*").repartition("address").dropDuplicates(["address"])
            chunks.write.mode("error" if new == _NEW[0] else "append").option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = staged.select("doc_id", "uid", "n_tokens", "addresses", "begins", "sizes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = recipes.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "uid").withColumn("part", F.spark_partition_id())
    with shuffles_dropped(spark):
        ranged.write.option("compression", "zstd").parquet(f"{folder}/ranged")
    ranged = spark.read.schema(ranged.schema).parquet(f"{folder}/ranged")
    removed(spark, f"{folder}/staged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    # A row for each range partition: as many as spark.sql.shuffle.partitions.
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    final = ranged.join(F.broadcast(before), "part").withColumn("start", (F.col("before") + inside).cast("long")).drop("before").withColumn("leaf", _leaf())
    final.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    removed(spark, f"{folder}/ranged")
    _merkle(spark.read.parquet(f"{folder}/recipes"), F.col("leaf")).write.parquet(f"{folder}/manifest")
    _root(spark.read.parquet(f"{folder}/manifest")).write.parquet(f"{folder}/root")


def _leaf() -> Column:
    """The hash of a recipe's columns."""
    numbers = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "uid", "start", "n_tokens")))
    return F.unhex(F.sha2(F.encode(F.concat_ws("/", numbers, F.array_join(F.col("begins").cast("array<string>"), ","), F.array_join(F.col("sizes").cast("array<string>"), ","), F.array_join(F.transform("addresses", F.hex), ",")), "utf-8"), 256))


def _root(manifest: DataFrame) -> DataFrame:
    """The hash of the parts' nodes and counts in order, as many as spark.sql.shuffle.partitions."""
    nodes = F.array_sort(F.collect_list(F.struct("part", "n_docs", "n_tokens", F.hex("node").alias("node"))))
    return manifest.agg(F.unhex(F.sha2(F.encode(F.array_join(F.transform(nodes, lambda x: F.concat_ws(":", x["part"].cast("string"), x["n_docs"].cast("string"), x["n_tokens"].cast("string"), x["node"])), ","), "utf-8"), 256)).alias("node"))


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes of a store; raises where a leaf, a node or the root isn't what they give."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    own = _leaf()
    checked = F.when(F.col("leaf") == own, own).otherwise(F.raise_error(F.lit("a recipe is damaged")).cast("binary"))
    stored, found = spark.read.parquet(f"{folder}/manifest"), _merkle(recipes, checked)
    if stored.exceptAll(found).union(found.exceptAll(stored)).take(1):
        raise ValueError("the recipes differ from the manifest")
    if spark.read.parquet(f"{folder}/root").collect() != _root(stored).collect():
        raise ValueError("the manifest differs from the root")
    return recipes


def _merkle(recipes: DataFrame, leaf: Column) -> DataFrame:
    """One node for each part over its leaves, in id order, by levels of up to 1,024 children, so no group is large."""
    ranked = recipes.withColumn("leaf", leaf).select("part", "n_tokens", "leaf", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "uid")).alias("k"))
    level = ranked.select("part", F.expr("(k - 1) div 1024").alias("k"), F.col("leaf").alias("node"), (F.col("k") - 1).alias("at"), F.lit(1).cast("long").alias("n_docs"), "n_tokens")
    for _ in range(3):  # up to 1024 ** 3 documents a part
        joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "node"))), F.unhex(F.lit("")), lambda s, x: F.concat(s, x["node"]))
        level = level.groupBy("part", "k").agg(F.unhex(F.sha2(joined, 256)).alias("node"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        level = level.select("part", F.expr("k div 1024").alias("k"), "node", F.col("k").alias("at"), "n_docs", "n_tokens")
    return level.select(F.col("part").cast("int").alias("part"), "n_docs", "n_tokens", "node")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = ("address", "n_ids", "width", "payload")
        rows = []
        for key, n, width, payload in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            ids = unpack(width, payload)
            if len(ids) != n or address(width, payload) != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            rows.append((key, len(ids), zlib.crc32(ids)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["address", "n_read", "crc"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_shift(batch.column("crc").to_numpy(zero_copy_only=False), 4 * batch.column("tail").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(crc.astype(np.int64)), batch.column("n_read")], ["uid", "crc", "n_read"])


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids).

    Every stored chunk is read, held against its address, and its checksum taken; recipes join those checksums, which
    combine into a document's without its ids in one place. Raises where a chunk is damaged or missing or a Merkle leaf,
    node or root differs. Chunks that many recipes name are in one row of the smaller side, which Spark's skew join copies.
    """
    ship_code(spark)
    chunks = spark.read.schema("address binary, n_ids int, width int, payload binary").parquet(f"{folder}/chunks")
    recipes = _verified(spark, folder)
    sums = chunks.mapInArrow(_measured, "address binary, n_read int, crc long")
    each = F.posexplode(F.arrays_zip("addresses", "begins", "sizes")).alias("k", "c")
    # ids after each chunk: what remains of the document
    used = recipes.select("uid", "n_tokens", each).select("uid", F.col("c.addresses").alias("address"), F.col("c.sizes").alias("size"), (F.col("n_tokens") - F.col("c.begins") - F.col("c.sizes")).alias("tail"))
    read = F.when(F.col("n_read") == F.col("size"), F.col("n_read")).otherwise(F.raise_error(F.lit("a chunk is missing or of another size")).cast("int"))
    joined = used.join(sums, "address", "left").select("uid", "tail", "crc", read.alias("n_read"))
    total = joined.mapInArrow(_shifted, "uid long, crc long, n_read int").groupBy("uid").agg(F.bit_xor("crc").alias("crc"), F.sum("n_read").alias("n_read"))
    return (
        recipes.select("doc_id", "start", "n_tokens", "uid").join(total, "uid", "left")
        .select("doc_id", "start", F.when(F.coalesce("n_read", F.lit(0)) == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is incomplete")).cast("long")).alias("n_tokens"), F.coalesce("crc", F.lit(0)).alias("ids_crc32"))
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' ids again: doc_id, uid, ids array<int>. A document's chunks meet in one row. Raises as read_back does."""
    ship_code(spark)
    chunks = spark.read.schema("address binary, n_ids int, width int, payload binary").parquet(f"{folder}/chunks")

    def checked(c: dict) -> np.ndarray:
        if c["payload"] is None:
            raise ValueError(f"chunk {c['address'].hex()} is missing")
        ids = unpack(c["width"], c["payload"])
        if len(ids) != c["n"] or address(c["width"], c["payload"]) != c["address"]:
            raise ValueError(f"chunk {c['address'].hex()} is damaged")
        return ids

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([checked(c) for c in sorted(x, key=lambda c: c["k"])]).astype(np.int32) for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array([list(x) for x in ids], pa.list_(pa.int32()))], ["doc_id", "uid", "ids"])

    used = _verified(spark, folder).select("doc_id", "uid", F.posexplode(F.arrays_zip("addresses", "sizes")).alias("k", "c")).select("doc_id", "uid", "k", F.col("c.addresses").alias("address"), F.col("c.sizes").alias("n"))
    parts = used.join(chunks, "address", "left").groupBy("doc_id", "uid").agg(F.collect_list(F.struct("k", "n", "address", "width", "payload")).alias("parts"))
    return parts.mapInArrow(rebuilt, "doc_id long, uid long, ids array<int>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return read_back(spark, folder)

