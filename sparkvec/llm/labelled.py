"""Bounded samples of labelled documents for training, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a model is trained on at most.
SAMPLE_ROWS = 3000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; labels are never learned from them. Null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(text, label, weight of the class) of at most rows documents of each class outside the held-out fold, and the share
    of each class among those labelled. Ids are taken in the order of their hash, so the sample is the same every time.
    A document with both labels counts as label 1."""
    known = labels.where(~held_out()).where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    shares = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}  # two rows
    picked = None
    for k in (0, 1):
        own = known.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = own if picked is None else picked.unionByName(own)
    # At most 2 * rows ids: a bound that doesn't grow.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    total = sum(shares.values())
    return texts.select("doc_id", "text", "_label"), {k: n / total for k, n in shares.items()}
