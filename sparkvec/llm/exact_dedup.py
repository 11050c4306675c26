"""Exact deduplication by two-pass Bloom filtering; DataFrame operations only.

The text is read once, into a narrow table of digests. A first pass over the digests sets the bits of a Bloom filter
and keeps the positions that two or more rows set; a second pass tests each digest against them. Only rows that may be
repeated are shuffled, each group reduced to one row before; all others pass straight through as kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm import bloom
from sparkvec.llm.common import join_groups, staged, table, text_or_empty, unused


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; nothing is trimmed."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def group_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, _uid (a row number), keep_id, group_size, kept and text_sha256.

    Null texts count as empty. The smallest id of a group stays; of rows that also share that id, one. A null id is
    larger than any other. An empty table gives no rows; other columns of docs are ignored.
    """
    digests = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty(text_col)), 256)).alias("digest")).withColumn("_uid", F.monotonically_increasing_id()),
        "digests",
    )
    total = digests.count()
    shards, parts = bloom.shard_count(total), []
    for s in range(shards):
        own = digests if shards == 1 else digests.where(F.pmod(F.xxhash64("digest"), F.lit(shards)) == s)
        bits = bloom.filter_bits(-(-total // shards))
        parts.append(bloom.mark_repeated(own, bloom.repeated_words(own, "digest", bits), "digest", bits, "_maybe"))
    marked = parts[0]
    for p in parts[1:]:
        marked = marked.unionByName(p)
    single = marked.where(~F.col("_maybe")).select("doc_id", "_uid", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = marked.where("_maybe").drop("_maybe")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")
    groups = maybe.groupBy("digest").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("group_size"))
    several = join_groups(maybe, groups, "digest", "group_size", total).select(
        "doc_id", "_uid", "digest", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_first._uid") == F.col("_uid")).alias("kept")
    )
    return single.unionByName(several).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: of equal texts that with the least id; of
    rows that also share the id, one. Null texts count as empty, a null id as larger than any other; no rows give none.

    A filter of the repeated digests lets rows that nothing repeats pass without a shuffle; of the others each task sends
    one row of each text.
    """
    row, digest, maybe = unused(docs.columns, "_row", "_digest", "_maybe")
    made = F.unhex(F.sha2(normalised(text_or_empty()), 256))
    digests = staged(docs.select(made.alias("digest")), "digests")
    total = digests.count()
    shards, groups = bloom.shard_count(total), None
    bits = bloom.filter_bits(-(-total // shards))
    for s in range(shards):
        own = digests if shards == 1 else digests.where(F.pmod(F.xxhash64("digest"), F.lit(shards)) == s)
        found = bloom.mark_repeated(own, bloom.repeated_words(own, "digest", bits), "digest", bits, "maybe").where("maybe").groupBy("digest").count().where("count > 1").select("digest")
        groups = found if groups is None else groups.unionByName(found)
    repeated = staged(groups, "repeated")
    bits = bloom.filter_bits(repeated.count())
    marked = bloom.mark_repeated(docs.withColumn(digest, made), bloom.member_words(repeated, "digest", bits), digest, bits, maybe)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = marked.where(F.col(maybe)).groupBy(digest).agg(F.min_by(F.struct(*columns), F.struct(F.col("doc_id").isNull(), "doc_id")).alias(row))
    return marked.where(~F.col(maybe)).select(*columns).unionByName(first.select(f"{row}.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_exact(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
