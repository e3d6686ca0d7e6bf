"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovekit.session import materialize as written
from trovekit.session import release as drop
from trovekit.session import ship_package

__all__ = ["drop", "each_time", "fold", "running_total", "split_buckets", "table", "word_count", "written"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def each_time(df: DataFrame, times: str, number: str | None = None, spread: int = 4_096) -> DataFrame:
    """Every row as often as its column ``times`` says, which goes; ``number`` names the repeat from 1.

    No array holds more than ``spread`` entries, however often a row comes.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != times]
    last = F.floor((F.col(times) - 1) / spread).cast("long")
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__block"))
    low = F.col("__block") * spread + 1
    rows = blocks.select(*kept, F.explode(F.sequence(low, F.least(low + spread - 1, F.col(times).cast("long")))).alias(number or "__number"))
    return rows if number else rows.drop("__number")


def split_buckets(rows: int, per_bucket: int = 8_192) -> int:
    """Number of buckets, a power of two, so that one holds about ``per_bucket`` rows."""
    n = 1
    while n * per_bucket < rows:
        n *= 2
    return n


def running_total(df: DataFrame, value: str, keys: Sequence[str], bucket: str, order: Sequence[Column | str], out: str) -> DataFrame:
    """Running sum of ``value`` within ``keys`` along ``order``, the row itself included.

    ``bucket`` is a non-null integer that rises with ``order``: sums of buckets are
    added up first, so no task holds more than one bucket of one key.  ``keys``
    must be non-null.  ``df`` is read twice; pass a written table.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("_inside", F.sum(value).over(inside))
    return ranked.join(sums, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def word_count(text: Column | str) -> Column:
    """Number of runs free of blank, tab, newline, vertical tab, form feed and return; 0 for NULL."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts
