"""MinHash near-deduplication with tensored banding.

A document's set is its distinct SHINGLE-word shingles. Two collections of ITEMS hashes, each hash made of DEPTH minhashes, are
computed once; a table's key is a pair of one hash from either, so ITEMS * ITEMS tables of 2 * DEPTH minhashes each come from
2 * ITEMS * DEPTH minhashes. Documents with equal sets are one class. A pair of similarity s shares no bucket with
probability at most 2 * (1 - s ** DEPTH) ** ITEMS, which is 3.5e-5 at 0.75.

Links are confirmed on the full sets. First the ITEMS tables that pair hashes of the same number are made, and in each bucket
all members are held against its least one, so a large group of copies costs a link each. All other tables matter only where
they join different components: hashes that one component alone has are dropped before pairs of them are formed. In buckets
with several components those outside the largest are held against HUBS members of that one.

Classes that still share a bucket with another component are compared by their rarest shingles: with shingles in one order,
rare ones first, two sets of n and m shingles that are similar enough share one among the first n - ceil(0.75 n) + 1 of the
one and m - ceil(0.75 m) + 1 of the other, and what follows the first shared one is long enough. This loses no link, and
documents with a long common passage alone don't meet, as its shingles come last. No bucket and no list is capped.

Pairs found in buckets are held against each other by four bits of each of the 2 * ITEMS * DEPTH minhashes before: those of
similarity 0.75 agree in 92 of 120 on average, and in fewer than AGREE with a probability of about one in two million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvec.llm import bloom
from sparkvec.llm.common import BATCH_BYTES, Scratch, join_groups, ship_code, small_batches, table, text_or_empty
from sparkvec.llm.components import components
from sparkvec.llm.words import released, strings

SHINGLE, PERCENT, ITEMS, DEPTH = 5, 75, 20, 3
HUBS = 8
#: The low bits of an item's hash that hold its number.
ITEM_BITS = (1 << (2 * ITEMS - 1).bit_length()) - 1
#: Minhashes whose four bits must agree before full sets are compared, and the 64-bit words that hold those bits.
AGREE, SIG_WORDS = 69, -(-2 * ITEMS * DEPTH // 16)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes: its distinct size-word shingles, or its words as one if they are fewer."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())))
    lists = pc.ascii_split_whitespace(lower)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    words = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in strings(coded.dictionary)], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
    full = words != 0  # pieces at the ends may be empty
    ends = np.concatenate([[0], np.cumsum(full)])[bounds]
    words = words[full]
    factors = _mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * factors[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(_mix(np.array([np.add.reduce(words[a:b] * factors[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def item_hashes(sets: list[np.ndarray], items: int = ITEMS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none empty: 2 * items hashes of depth minhashes each (the first half is one collection), and four bits
    of each minhash, sixteen to a word."""
    sizes = np.array([len(s) for s in sets])
    joined, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    factors = _mix(np.arange(1, 2 * items * depth + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    out, bits = np.zeros((len(sets), 2 * items), np.uint64), np.zeros((len(sets), -(-2 * items * depth // 16)), np.uint64)
    for k, f in enumerate(factors):
        least = np.minimum.reduceat(_spread(joined, f), starts)
        out[:, k // depth] = _mix(out[:, k // depth] * np.uint64(3) + least + np.uint64(k // depth))
        bits[:, k // 16] |= (least & np.uint64(15)) << np.uint64(4 * (k % 16))
    return out, bits


def _spread(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    y = x * factor
    return (y ^ (y >> np.uint64(32))) * factor


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(small_batches(batches, most=BATCH_BYTES // 2)):
        if not batch.num_rows:
            continue
        sets = shingle_sets(batch.column("text"))
        some = [i for i, s in enumerate(sets) if len(s)]
        items: list = [None] * len(sets)
        sigs: list = [None] * len(sets)
        for at in range(0, len(some), 64):
            own = some[at : at + 64]
            for i, row, bits in zip(own, *(x.view(np.int64) for x in item_hashes([sets[i] for i in own])), strict=True):
                items[i], sigs[i] = row, bits
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("uid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(items, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
            ["doc_id", "uid", "n", "key", "items", "sig"],
        )


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(small_batches(batches, most=BATCH_BYTES // 2)):
        if batch.num_rows:
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "key", "set"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fits(a: str, b: str) -> str:
    """Sizes that allow the similarity."""
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def _alike(a: str, b: str) -> str:
    """At least AGREE minhashes have the same four bits: a nibble of the xor is zero where they do. Unused nibbles agree."""
    unused = 16 * SIG_WORDS - 2 * ITEMS * DEPTH
    differ = []
    for w in range(SIG_WORDS):
        x = f"({a}[{w}] ^ {b}[{w}])"
        differ.append(f"bit_count(({x} | shiftright({x}, 1) | shiftright({x}, 2) | shiftright({x}, 3)) & 1229782938247303441)")  # 0x1111...
    return f"{16 * SIG_WORDS} - ({' + '.join(differ)}) >= {AGREE + unused}"


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, uid, n_shingles, component_id, kept.

    Null and empty texts have empty sets and are linked with nothing. component_id is the least id of the component; kept
    is true for each row with that id. Null ids count as larger than others, and rows that have no other id are kept.
    Rows with one id and different texts are rows of their own. Texts of any length are read whole, in sets of 8 bytes a
    shingle. Other columns are ignored; an empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), text_or_empty().alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        stage = scratch.stage
        signed = stage(own.mapInArrow(_signed, "doc_id long, uid long, n long, key binary, items array<long>, sig array<long>"), "signed")
        total = signed.count()
        classes = stage(signed.where("n > 0").groupBy("key").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")), "classes")
        reps = stage(signed.join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("cid"), "n", "items", "sig"), "reps")
        ids = stage(signed.select("doc_id", "uid", "n", "key"), "ids")
        scratch.drop(signed)
        sigs = reps.select("cid", "n", "sig")

        def confirmed(pairs: DataFrame) -> DataFrame:
            likely = stage(_likely(pairs, sigs), "likely")
            sets = _sets(likely.select(F.explode(F.array("x", "y")).alias("cid")).distinct(), ids, own, total, scratch)
            links = stage(_confirm(likely, sets), "links")
            scratch.drop(likely, sets)
            return links

        keys = reps.select("cid", F.explode(F.expr(f"transform(slice(items, 1, {ITEMS}), (a, i) -> xxhash64(a, items[{ITEMS} + i], i))")).alias("k"))
        first = keys.groupBy("k").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("k", "x")
        links = confirmed(keys.join(first, "k").where("cid <> x").select("x", F.col("cid").alias("y")).distinct())
        roots = components(links, scratch)
        mixed = _mixed(_tensored(reps, roots), roots, scratch)
        if mixed.take(1):
            links = links.unionByName(confirmed(_hub_pairs(mixed)))
            roots = components(links, scratch)
            rest = _mixed(mixed.select("k", "cid"), roots, scratch)
            scratch.drop(mixed)
            if rest.take(1):
                sets = _sets(rest.select("cid").distinct(), ids, own, total, scratch)
                pairs = stage(_rare_pairs(sets, roots, scratch), "pairs")
                further = stage(_confirm(pairs, sets), "links")
                scratch.drop(pairs, sets)
                roots = components(links.unionByName(further), scratch)

        named = classes.join(roots, classes["cid"] == roots["v"], "left").select("key", "size", "low", F.coalesce("root", "cid").alias("root"))
        least = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("size").alias("_of"))
        labelled = join_groups(named, least, "root", "_of", total).select("key", "size", "component_id")
        out = join_groups(ids, labelled, "key", "size", total)
        out = out.select("doc_id", "uid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        out = stage(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())), "near-groups")
        scratch.keep(out)
    return out


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with root, the component of cid; a class without links is its own."""
    return members.join(roots, members["cid"] == roots["v"], "left").withColumn("root", F.coalesce("root", "cid")).drop("v")


def _several(members: DataFrame, key: str) -> DataFrame:
    """The keys under which members of several components stand."""
    return members.groupBy(key).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select(key)


def _tensored(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, cid): the keys of all tables, pairs of a hash of either collection, from hashes that several components have. If
    two classes of different components share a key, they share both hashes, so no such bucket is lost."""
    items = _rooted(reps.select("cid", "items"), roots).select("cid", "root", F.posexplode("items").alias("at", "h")).select("cid", "root", F.expr(f"(xxhash64(at, h) & ~{ITEM_BITS}L) | at").alias("h"))
    left = items.join(_several(items, "h"), "h", "left_semi").groupBy("cid").agg(F.collect_list("h").alias("own"))  # 2 * ITEMS at most
    pairs = left.select("cid", F.expr(f"filter(own, h -> (h & {ITEM_BITS}) < {ITEMS})").alias("a"), F.expr(f"filter(own, h -> (h & {ITEM_BITS}) >= {ITEMS})").alias("b"))
    return pairs.select("cid", F.explode("a").alias("a"), "b").select("cid", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("k"), "cid")


def _mixed(members: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (k, cid) of buckets with several components: k, cid, root, and dom, the component with most of the bucket's members."""
    rooted = scratch.stage(_rooted(members, roots), "rooted")
    rest = rooted.join(_several(rooted, "k"), "k", "left_semi")
    largest = rest.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.max(F.struct("c", "root")).alias("m"))
    mixed = scratch.stage(rest.join(largest.select("k", F.col("m.root").alias("dom")), "k"), "mixed")
    scratch.drop(rooted)
    return mixed


def _hub_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (x, y) of up to HUBS members of each bucket's largest component, the same ones in many buckets, and each of the others."""
    part = F.pmod(F.xxhash64("cid"), F.lit(HUBS))
    least = [F.min(F.when(part == i, F.col("cid"))) for i in range(HUBS)]
    hubs = mixed.where("root = dom").groupBy("k").agg(F.array(*least).alias("hubs")).select("k", F.explode("hubs").alias("x")).where("x is not null")
    return mixed.where("root <> dom").select("k", F.col("cid").alias("y")).join(hubs, "k").select("x", "y").distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, n, h) for each shingle of each set."""
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("set")]
        for at in range(0, len(sets), 256):
            own = sets[at : at + 256]
            sizes = np.array(list(map(len, own)))
            cids = batch.column("cid").to_numpy()[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))], ["cid", "n", "h"])


def _rare_pairs(sets: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (x, y) of different components that share one of their rarest shingles, early enough in both; all similar
    pairs are among them. Pairs inside the largest component of a shingle's list aren't made."""
    every = scratch.stage(sets.mapInArrow(_shingles, "cid long, n long, h long"), "shingles")
    times = every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # Shingles that one set alone has come first in the order and meet nothing.
    counted = join_groups(every, scratch.stage(times, "times"), "h", "c", every.count()).withColumn("c", F.coalesce("c", F.lit(1)))
    ranked = counted.withColumn("i", F.row_number().over(Window.partitionBy("cid").orderBy("c", "h"))).where(f"i <= n - (n * {PERCENT} + 99) div 100 + 1 and c > 1")
    early = _mixed(ranked.select("cid", "n", "i", F.col("h").alias("k")), roots, scratch)
    x, y = (early.select("k", "dom", *(F.col(c).alias(f"{c}_{side}") for c in ("cid", "n", "i", "root"))) for side in "xy")
    enough = f"least(n_x - i_x, n_y - i_y) + 1 >= ({PERCENT} * (n_x + n_y) + {99 + PERCENT}) div {100 + PERCENT}"
    met = x.where("root_x <> dom").join(y.drop("dom"), "k").where(f"root_x <> root_y and (root_y = dom or cid_x < cid_y) and {_fits('n_x', 'n_y')} and {enough}")
    return met.select(F.col("cid_x").alias("x"), F.col("cid_y").alias("y")).distinct()


def _sets(members: DataFrame, ids: DataFrame, own: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """(cid, set) of members (cid), made again from the texts. A Bloom filter of the ids lets most other rows go."""
    wanted = scratch.stage(ids.select("doc_id", F.col("uid").alias("cid"), "key").join(members, "cid", "left_semi"), "wanted")
    bits = bloom.filter_bits(max(1, total // 4))
    likely = bloom.mark_repeated(own, bloom.member_words(wanted, "doc_id", bits), "doc_id", bits, "_maybe").where("_maybe").select("doc_id", "text")
    made = likely.mapInArrow(_sets_of, "doc_id long, key binary, set binary").withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    joined = wanted.join(made, (wanted["key"] == made["_key"]) & wanted["doc_id"].eqNullSafe(made["_id"]))
    out = scratch.stage(joined.select("cid", "set").dropDuplicates(["cid"]), "sets")
    scratch.drop(wanted)
    return out


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sizes allow the similarity and whose minhashes agree often enough."""
    a, b = (sigs.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "xy")
    return pairs.join(b, "y").join(a, "x").where(f"{_fits('nx', 'ny')} and {_alike('sx', 'sy')}").select("x", "y")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    x, y = (sets.select(F.col("cid").alias(c), F.col("set").alias(f"set_{c}")) for c in "xy")
    return pairs.join(y, "y").join(x, "x").select("x", "y", "set_x", "set_y").mapInArrow(_confirmed(PERCENT), "x long, y long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each component, and all with empty sets. All columns are kept, whatever their
    names. Rows that share an id stay together if one of them stays; rows without an id stay. No rows give none."""
    marks = near_groups(docs)
    gone = marks.groupBy("doc_id").agg(F.max("kept").alias("k")).where("not k").select("doc_id")
    return bloom.without_ids(docs, gone, marks.count())


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
