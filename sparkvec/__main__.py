"""Commands: ingest DIR DIM COUNT [CHECKPOINT_EVERY], verify DIR DIM ACKED, orphans DIR DIM, search DIR DIM ID K.

Vectors are functions of their ids, so verify can tell whether each came back as it was. ingest goes on where the collection
ends and prints ACK and an id once that vector is stored. The exit code is 0, 1 for what failed and 2 for wrong arguments.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkvec.db import NO_ID, VectorDb
from sparkvec.errors import InvalidArgument
from sparkvec.sources.synthetic import by_id, vectors_of
from sparkvec.streaming import ingest as checks

USAGE = "usage:\n  ingest <dir> <dim> <count> [checkpoint_every]\n  verify <dir> <dim> <acked>\n  orphans <dir> <dim>\n  search <dir> <dim> <id> <k>"
#: Vectors that one add stores, and the share of unreachable nodes that a sound graph may have.
BATCH, UNREACHABLE = 1000, 0.001


def ingest(spark: SparkSession, path: str, dim: int, count: int, checkpoint_every: int | None = None) -> int:
    if checkpoint_every is not None and checkpoint_every <= 0:
        raise InvalidArgument("checkpoint_every must be greater than zero")
    db = VectorDb(spark, path, dim)
    step = min(BATCH, checkpoint_every or BATCH)
    while (start := len(db)) < count:
        stop = min(count, (start // step + 1) * step)
        first = db.add(vectors_of(np.arange(start, stop), dim))
        for i in range(first, first + stop - start):
            print(f"ACK {i}", flush=True)
        if checkpoint_every and stop % checkpoint_every == 0:
            db.checkpoint()
    db.checkpoint()
    print(f"DONE {count}")
    return 0


def verify(spark: SparkSession, path: str, dim: int, acked: int) -> int:
    db = VectorDb(spark, path, dim)
    if len(db) < acked:
        return _failed(f"the collection has {len(db)} vectors, {acked} were acknowledged")
    db.verify()
    found = checks.verify(db.store.frame(), by_id(spark.range(acked).select(F.col("id").alias("vec_id")), dim)).first()
    if found["missing"] or found["mismatched"]:
        return _failed(f"{found['missing']} vectors are missing and {found['mismatched']} differ")
    orphans = db.orphan_count() if len(db) else 0
    if orphans > UNREACHABLE * max(1, len(db)):
        return _failed(f"{orphans} of {len(db)} nodes can't be reached")
    print(f"OK len={len(db)} orphans={orphans}")
    return 0


def orphans(spark: SparkSession, path: str, dim: int) -> int:
    db = VectorDb(spark, path, dim)
    print(f"len={len(db)} orphans={db.orphan_count() if len(db) else 0}")
    return 0


def search(spark: SparkSession, path: str, dim: int, vec_id: int, k: int) -> int:
    ids, distances = VectorDb(spark, path, dim).search(vectors_of(np.array([vec_id]), dim), k, 128)
    for i, d in zip(ids[0], distances[0], strict=True):
        if i != NO_ID:
            print(f"{i}\t{d}")
    return 0


def _failed(why: str) -> int:
    print(f"FAIL: {why}", file=sys.stderr)
    return 1


#: The commands and how many arguments each takes at least and at most, the folder among them.
COMMANDS = {"ingest": (ingest, 3, 4), "verify": (verify, 3, 3), "orphans": (orphans, 2, 2), "search": (search, 4, 4)}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    run, least, most = COMMANDS.get(argv[0] if argv else "", (None, 0, 0))
    numbers = argv[2:]
    if run is None or not least <= len(argv) - 1 <= most or not all(n.isdecimal() for n in numbers):
        print(USAGE, file=sys.stderr)
        return 2
    try:
        return run(spark or SparkSession.builder.getOrCreate(), argv[1], *map(int, numbers))
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
