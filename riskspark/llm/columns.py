"""Column functions over long arrays, in linear time.

A fold that appends to an array copies what it has, and an expression inside a lambda is computed
again for every element. So folds run inside chunks whose results are flattened, and values that
several lambdas need are bound once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of one chunk.
CHUNK = 128


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def chunks(items: Column) -> Column:
    """An array in pieces of :data:`CHUNK` (one empty piece for an empty array)."""
    n = F.ceil(F.size(items) / F.lit(CHUNK)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))


def starts(pieces: Column, value, join) -> Column:
    """For each chunk what ``join`` makes of the ``value`` of all chunks before it, from 0."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(pieces, start, lambda a, c: F.struct(
        join(a["at"], value(c)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"])


def running(items: Column, size, make, kind: str) -> Column:
    """``make(at, x)`` of every element, ``at`` being the sum of ``size`` (a long) of those before it;
    ``kind`` is the type of the resulting array."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + size(x))

    def fold(chunk, first):
        start = F.struct(first.alias("at"), F.array().cast(kind).alias("all"))
        return F.aggregate(chunk, start, lambda a, x: F.struct(
            (a["at"] + size(x)).alias("at"), F.array_append(a["all"], make(a["at"], x)).alias("all")), lambda a: a["all"])

    return let(items, lambda all_: let(chunks(all_), lambda c: F.flatten(
        F.zip_with(c, starts(c, total, lambda x, y: x + y), fold))))
