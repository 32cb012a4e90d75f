"""Vector functions on arrays of numbers, and an embedder that needs no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: as it stands in a lambda function, an expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    """At unit length; a vector without length stays as it is."""
    unit = lambda v, size: F.transform(v, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))
    return _once(a, lambda v: _once(norm(v), lambda size: unit(v, size)))


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """Feature hashing: signed counts of tokens by hash, at unit length. Native, so no model is loaded."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    signs = F.transform(tokens, lambda t: F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0))
    both = F.arrays_zip(places.alias("p"), signs.alias("s"))
    counted = lambda pairs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(pairs, lambda x: x["p"] == i), F.lit(0.0), lambda n, x: n + x["s"]))
    return normalised(_once(both, counted))
