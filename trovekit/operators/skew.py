"""Equi-joins and running totals that stay balanced when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS = 500_000
MAX_HOT_KEYS = 4096
SAMPLE = 32


def hot_keys(
    df: DataFrame, keys: list[str], slice_rows: int = SLICE_ROWS, spread_by: list[str] | None = None, sample: int = SAMPLE
) -> DataFrame:
    """The most frequent keys and how many slices each is cut into.

    Frequencies are estimated on one row in ``sample``, picked by the hash of
    ``spread_by``, so finding hot keys costs a fraction of the input.  A hot key
    holds more than one ``MAX_HOT_KEYS``-th of all rows, so there are fewer than
    ``MAX_HOT_KEYS`` of them and the table can be broadcast.  A key that the
    estimate misses is not sliced: no row of a join depends on it.
    """
    rows = df
    if sample > 1 and spread_by:
        rows = df.where(F.pmod(F.xxhash64(*spread_by, F.lit(7)), F.lit(sample).cast("long")) == 0)
    scale = sample if rows is not df else 1
    counted = rows.groupBy(*keys).agg((F.count(F.lit(1)) * scale).alias("__count"))
    share = F.coalesce((rows.agg(F.count(F.lit(1)) * scale)).scalar(), F.lit(0)) / MAX_HOT_KEYS
    hot = counted.where(F.col("__count") > F.greatest(F.lit(slice_rows), share))
    return hot.select(*keys, F.ceil(F.col("__count") / slice_rows).cast("int").alias("__slices"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str] | str, how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL meets NULL; the result has the keys of ``left`` once."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    other = right.select(*[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"__right_{k}"])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | str,
    how: str = "inner",
    slice_rows: int = SLICE_ROWS,
    spread_by: list[str] | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """Many-to-many join where keys may be hot on the left side.

    Left rows of a hot key are spread over slices by their own hash, right rows
    of that key are repeated once per slice.  The result equals the plain join.
    ``spread_by`` names left columns that tell its rows apart (default: the
    scalar columns outside the key).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if spread_by is None:
        nested = (T.ArrayType, T.MapType, T.VariantType)
        spread_by = [f.name for f in left.schema.fields if f.name not in keys and not isinstance(f.dataType, nested)]
    hot = F.broadcast(hot_keys(left, keys, slice_rows, spread_by, sample))
    spread = F.xxhash64(*(spread_by or keys))
    l = left.join(hot, keys, "left").withColumn(
        "__slice", F.pmod(spread, F.coalesce("__slices", F.lit(1)).cast("long")).cast("int")
    )
    r = right.join(hot, keys, "left").withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1))
    )
    return l.drop("__slices").join(r.drop("__slices"), [*keys, "__slice"], how).drop("__slice")


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str] | str, how: str = "inner") -> DataFrame:
    """Join to a side whose key is unique.

    Every left row meets at most one right row, so a hot key only makes one
    shuffle partition large; adaptive execution splits such partitions
    (``spark.sql.adaptive.skewJoin``) or broadcasts a right side it has measured
    to be small.  No salt is needed, and the left side is computed once.
    """
    return left.join(right, keys, how)


def chunked_changes(
    df: DataFrame, key: str, position: str, value: str, width: int = 100_000, out: str = "changes"
) -> DataFrame:
    """Per key, how often ``value`` differs from the previous row of the key.

    Rows of a key are cut into position chunks; only the first and last value
    of each chunk meet across chunks.
    """
    rows = df.withColumn("__chunk", F.floor(F.col(position) / width))
    inside = Window.partitionBy(key, "__chunk").orderBy(position)
    changed = F.coalesce((F.lag(value).over(inside) != F.col(value)).cast("long"), F.lit(0))
    chunks = (
        rows.withColumn("__changed", changed)
        .groupBy(key, "__chunk")
        .agg(
            F.sum("__changed").alias("__inside"),
            F.min_by(value, position).alias("__first"),
            F.max_by(value, position).alias("__last"),
        )
    )
    across = Window.partitionBy(key).orderBy("__chunk")
    border = F.coalesce((F.lag("__last").over(across) != F.col("__first")).cast("long"), F.lit(0))
    return chunks.withColumn("__border", border).groupBy(key).agg(
        (F.sum("__inside") + F.sum("__border")).alias(out)
    )


def chunked_running_sum(
    df: DataFrame, key: str | list[str], position: str, value: Column, out: str, width: int = 100_000
) -> DataFrame:
    """Running sum of ``value`` per key in position order, chunk by chunk."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.withColumn("__chunk", F.floor(F.col(position) / width)).withColumn("__value", value)
    totals = rows.groupBy(*keys, "__chunk").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk")
    before = totals.select(*keys, "__chunk", (F.sum("__total").over(earlier) - F.col("__total")).alias("__before"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("__inside", F.sum("__value").over(inside))
    joined = null_safe_join(running, before, [*keys, "__chunk"])
    return joined.withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop(
        "__chunk", "__value", "__inside", "__before"
    )
