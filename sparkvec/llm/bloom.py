"""Two-pass Bloom filtering with DataFrame operations: which hashes may occur more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import unused

#: Bits of filter for each row, and the most that one filter has (16 MB); beyond, hashes are dealt over several filters.
BITS_PER_ROW, MAX_BITS = 8, 1 << 27


def shard_count(rows: int) -> int:
    """How many filters of at most MAX_BITS hold that many rows."""
    return max(1, -(-rows * BITS_PER_ROW // MAX_BITS))


def _positions(h: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(h), F.lit(k)), F.lit(bits)) for k in (1, 2)]


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, 1 << max(10, (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def repeated_words(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """First pass: the filter's positions that at least two rows set, as 64-bit words (word, mask)."""
    return (
        hashes.select(F.explode(F.array(*_positions(h, bits))).alias("p"))
        .groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))
    )


def mark_repeated(rows: DataFrame, words: DataFrame, h: str, bits: int, out: str) -> DataFrame:
    """Second pass, without a shuffle: rows with out, which is false only where no other row has the same hash. The filter has
    at most MAX_BITS / 64 words, so it is broadcast. rows may have columns of any names; one named as out is replaced."""
    row, marked, hit = unused(rows.columns, "_row")[0], rows, []
    marked = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != out)).alias(row), *(p.alias(f"_p{k}") for k, p in enumerate(_positions(h, bits))))
    for k in (0, 1):
        own = words.select(F.col("word").alias(f"_w{k}"), F.col("mask").alias(f"_m{k}"))
        marked = marked.join(F.broadcast(own), F.shiftright(f"_p{k}", 6) == F.col(f"_w{k}"), "left")
        hit.append(F.expr(f"coalesce(shiftright(_m{k}, cast(_p{k} & 63 as int)) & 1, 0) = 1"))
    return marked.select(f"{row}.*", (hit[0] & hit[1]).alias(out))


def member_words(values: DataFrame, h: str, bits: int) -> DataFrame:
    """The filter's positions that any row sets, as 64-bit words."""
    return (
        values.select(F.explode(F.array(*_positions(h, bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))
    )


def without_ids(docs: DataFrame, gone: DataFrame, total: int) -> DataFrame:
    """docs without the rows whose doc_id is in gone (one column, distinct; null equals null). A filter of gone, of at most
    MAX_BITS, lets rows that surely stay pass without a shuffle. docs may have columns of any names."""
    maybe, name = unused(docs.columns, "_maybe", "_gone")
    gone, bits = gone.toDF(name), filter_bits(total)
    marked = mark_repeated(docs, member_words(gone, name, bits), "doc_id", bits, maybe)
    left = marked.where(F.col(maybe)).join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(left).select(*(F.col(f"`{c}`") for c in docs.columns))
