"""Vector distances as column expressions: sequential folds in double precision, smaller is nearer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvec.errors import InvalidArgument


def _fold(a: Column, b: Column, each: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(a, b, lambda x, y: each(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def dot_distance(a: Column, b: Column) -> Column:
    """The negated inner product; a zero is positive, so that ties fall to the id."""
    return -inner_product(a, b) + F.lit(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; exactly 1 where either norm is zero."""
    norms = F.sqrt(inner_product(a, a) * inner_product(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - inner_product(a, b) / F.when(norms != 0, norms))


def same_length(a: Column, b: Column) -> Column:
    """True, or an error where the arrays' lengths differ: zip_with would pad silently."""
    return F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("boolean"))


#: The names that metrics have in the interface.
METRICS = {"l2": l2_squared, "ip": dot_distance, "dot": dot_distance, "cosine": cosine_distance}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise InvalidArgument(f"unknown metric {name!r}: one of {', '.join(METRICS)}")
    return METRICS[name]
