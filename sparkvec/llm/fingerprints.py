"""Canonical exact digests of documents; DataFrame operations only.

The canonical form of a text is NFKC-normalised, case-folded (upper, then lower case) and has each run of white space as
one space, none at the ends. Its fingerprint is a 128-bit xxhash. Inside buckets of equal hashes the canonical texts are
compared byte by byte; texts that differ there get the rank of their text in the bucket appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvec.llm import bloom
from sparkvec.llm.common import staged, table, text_or_empty

#: Sets the second half of a wide hash apart from the first.
_SALT = "second half"


def canonical(text: Column) -> Column:
    """NFKC by the ICU library that Spark has on its class path, case folding, white-space folding. Never null."""
    normal = F.coalesce(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)), F.lit(""))
    folded = F.replace(F.lower(F.upper(normal)), F.lit("ß"), F.lit("ss"))  # upper() leaves this letter as it is
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(_SALT), text))))


def collisions(docs: DataFrame) -> DataFrame:
    """Canonical texts that share their hash with another: bucket, text, rank (from 0 in byte order). Almost always empty.

    docs has text. Only rows whose hash a Bloom filter finds possibly repeated are shuffled, each task's rows of a bucket
    reduced to the least and greatest text.
    """
    hashes = staged(docs.select(wide_hash(canonical(text_or_empty())).alias("bucket")), "hashes")
    return _collisions(docs, hashes)


def _collisions(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    total = hashes.count()
    shards = bloom.shard_count(total)
    bits = bloom.filter_bits(-(-total // shards))
    texts = docs.select(canonical(text_or_empty()).alias("text")).withColumn("bucket", wide_hash(F.col("text")))
    found = None
    for s in range(shards):
        of = F.pmod(F.xxhash64("bucket"), F.lit(shards)) == s
        own, rows = (hashes, texts) if shards == 1 else (hashes.where(of), texts.where(of))
        maybe = bloom.mark_repeated(rows, bloom.repeated_words(own, "bucket", bits), "bucket", bits, "_maybe").where("_maybe").select("bucket", "text")
        mixed = maybe.groupBy("bucket").agg(F.min("text").alias("least"), F.max("text").alias("most")).where(F.col("least") != F.col("most")).select("bucket")
        found = mixed if found is None else found.unionByName(mixed)
    mixed = staged(found, "mixed-buckets")
    if not mixed.take(1):
        return docs.sparkSession.createDataFrame([], "bucket string, text string, rank int")
    distinct = texts.join(mixed, "bucket", "left_semi").dropDuplicates(["bucket", "text"])
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("text")) - 1)


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with the column fingerprint. Null text counts as empty; equal texts have equal fingerprints; texts whose
    canonical forms differ never do. No rows give no rows; docs keeps its other columns (one named fingerprint is replaced)."""
    hashed = docs.withColumn("_canonical", canonical(text_or_empty())).withColumn("_bucket", wide_hash(F.col("_canonical")))
    mixed = collisions(docs.select("text"))
    if not mixed.take(1):
        return hashed.withColumn("fingerprint", F.col("_bucket")).drop("_canonical", "_bucket")
    named = mixed.select(F.col("bucket").alias("_b"), F.col("text").alias("_t"), F.col("rank").alias("_r"))
    joined = hashed.join(named, (F.col("_bucket") == F.col("_b")) & (F.col("_canonical") == F.col("_t")), "left")
    return joined.withColumn("fingerprint", F.when(F.coalesce("_r", F.lit(0)) > 0, F.concat_ws("-", "_bucket", F.col("_r").cast("string"))).otherwise(F.col("_bucket"))).drop("_canonical", "_bucket", "_b", "_t", "_r")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id and columns) and, as next_<column>, those of the next row in descending order of doc_id (nulls last,
    rows of one id by the first column), after the last the first. The rows move once: they are dealt by ranges of ids,
    of which each also gets the first row of the range that follows.
    """
    spark = docs.sparkSession
    ranges = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id").where("doc_id is not null")
    # One array of as many ids as there are ranges.
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # range 0 holds the null ids, the last range the largest ids
    width = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + (F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)))
    first = docs.select("doc_id").groupBy(width.alias("range")).agg(F.max("doc_id").alias("first")).collect()  # a row for each range
    order = sorted((r["range"] for r in first), reverse=True)
    top = {r["range"]: r["first"] for r in first}
    guests = [(top[b], a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)]  # the first id of b also goes to a, after a's rows
    own = docs.withColumn("_range", width)
    keys = spark.createDataFrame([(g, a, b) for g, a, b in guests], "_first long, _to int, _from int")
    sent = own.join(F.broadcast(keys), (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")), "inner")
    rows = own.withColumn("_guest", F.lit(0)).unionByName(sent.drop("_range", "_first", "_from").withColumnRenamed("_to", "_range").withColumn("_guest", F.lit(1)))
    w = Window.partitionBy("_range").orderBy("_guest", F.desc_nulls_last("doc_id"), columns[0])
    dealt = rows.repartition(max(ranges // 4, 1), "_range")
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("_guest = 0").drop("_guest", "_range")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of exact digests is 1 where they are equal and else 0. Repeated ids are rows of their own."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    hashed = docs.withColumn("bucket", wide_hash(canonical(F.col("text"))))
    pairs = with_next(hashed, ["text", "bucket"]).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    both = pairs.withColumn("_edit_form", canonical(F.col("edit"))).withColumn("edited_bucket", wide_hash(F.col("_edit_form")))
    same = lambda a, b, x, y: F.when(F.col(a) != F.col(b), F.lit(False)).otherwise(x == y)  # noqa: E731  bytes only inside a bucket
    rows = staged(
        both.select(
            "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edit", "utf-8"), 256).alias("edited_sha256"), "bucket", "edited_bucket",
            same("bucket", "edited_bucket", canonical(F.col("text")), F.col("_edit_form")).alias("same_edit"),
            same("bucket", "next_bucket", canonical(F.col("text")), canonical(F.col("next_text"))).alias("same_next"),
        ),
        "fingerprints",
    )
    mixed = _collisions(docs, rows.select("bucket"))
    if mixed.take(1):  # hashes that collide: name each text by its rank, over the texts themselves
        named = fingerprint(docs.withColumn("_n", F.char_length("text"))).select("doc_id", F.col("_n").cast("long").alias("n_chars"), "fingerprint").dropDuplicates(["doc_id", "n_chars"])
        rows = rows.join(named, ["doc_id", "n_chars"], "left")
    else:
        rows = rows.withColumn("fingerprint", F.col("bucket"))
    other = F.when(F.col("same_edit"), F.col("fingerprint")).when(F.col("bucket") == F.col("edited_bucket"), F.concat(F.col("edited_bucket"), F.lit("-edited"))).otherwise(F.col("edited_bucket"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", other.alias("edited_fingerprint"), F.col("same_edit").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"))
