"""Pseudo-random order and choice that do not depend on partitioning.

Sampling everywhere in this package orders rows by ``md5(seed:id)``: re-running
a lost task, another cluster size or another engine gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 2023


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(key, seed: int | str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def hash_int(key, seed: int | str = SEED) -> Column:
    """First 32 bits of the hash as a non-negative long."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")


def pick(values, key, seed: int | str = SEED) -> Column:
    """One element of ``values``, chosen by the hash of ``key``."""
    v = _col(values)
    size = F.greatest(F.size(v), F.lit(1)).cast("long")
    return F.try_element_at(v, (F.pmod(hash_int(key, seed), size) + 1).cast("int"))


def shuffled(values, key, seed: int | str = SEED) -> Column:
    """``values`` in an order fixed by the hash of ``key`` and the position."""
    keyed = F.transform(
        _col(values),
        lambda v, i: F.struct(
            hash_order(F.concat_ws(":", _col(key).cast("string"), i.cast("string")), seed).alias("h"), v.alias("v")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def cycled(values, n: int) -> Column:
    """``n`` elements of ``values``, starting over when it is shorter."""
    v = _col(values)
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.try_element_at(v, (F.pmod(i, F.greatest(F.size(v), F.lit(1))) + 1).cast("int")),
    )
    return F.when(F.size(v) > 0, picks).otherwise(F.slice(v, 1, 0))
