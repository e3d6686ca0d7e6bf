"""Dense numbering in a global order, without a single-partition window.

Rows are written once with a number of their own.  Above one bucket only the order
columns and those numbers are sorted: ranges that Spark measures on the written rows,
cut by the row's number where the order does not tell rows apart, so a value (or NULL)
that most rows share is spread like any other.  Only range sizes are summed up
globally; the wide rows meet their numbers in one join.  The input is evaluated once,
and nothing depends on how its rows happen to be partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovekit.functions.ids import make_id
from trovekit.functions.stable import SEED, hash_order
from trovekit.session import materialize

# Small enough that a bucket whose rows are exploded a hundredfold still fits a
# task, large enough that the table of bucket sizes stays small.
BUCKET_ROWS = 100_000
#: the number a stored row is known by; no caller's column has this name
ROW = "__stored_row"


def position_bucket(position, width: int = BUCKET_ROWS) -> Column:
    """Bucket of an integer position; at most ``width`` positions each."""
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / F.lit(width))


def stored_rows(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` written once, every row with a number ``ROW`` of its own."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), label)


def number_stored(
    rows: DataFrame, order: list, out: str, start: int = 1, bucket_rows: int = BUCKET_ROWS, count: int | None = None
) -> DataFrame:
    """(ROW, out) of ``rows``, which have ROW: their numbers start, start+1, ... by ``order``, then ROW."""
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"__k{i}") for i, o in enumerate(order)]
    narrow = rows.select(ROW, *keys)
    by = [f"__k{i}" for i in range(len(order))] + [ROW]
    parts = -(-(rows.count() if count is None else count) // bucket_rows)
    if parts <= 1:
        return narrow.select(ROW, (F.row_number().over(Window.orderBy(*by)) + F.lit(start - 1)).cast("long").alias(out))
    ranged = narrow.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # the high bits of the place are the range, the low ones count its rows
    placed = materialize(ranged.select(ROW, F.monotonically_increasing_id().alias("__at")), "number")
    bits = 33
    inside = F.col("__at").bitwiseAND(F.lit((1 << bits) - 1))
    ranges = placed.groupBy(F.shiftright("__at", bits).alias("__range")).agg((F.max(inside) + 1).alias("__size"))
    # one row per range: the only global ordering
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")
    offsets = ranges.select("__range", before.alias("__before"))
    numbered = placed.withColumn("__range", F.shiftright("__at", bits)).join(F.broadcast(offsets), "__range")
    return numbered.select(ROW, (F.col("__before") + inside + F.lit(start)).cast("long").alias(out))


def number_rows(df: DataFrame, order, out: str = "n", start: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``out`` = start, start+1, ... in the given order; NULL comes first.

    ``order`` names columns or expressions of any orderable type (integers, dense or
    sparse, text, file positions).
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    rows = stored_rows(df, "number")
    count = rows.count()
    if count <= bucket_rows:
        number = F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)
        return rows.withColumn(out, number.cast("long")).drop(ROW)
    return rows.join(number_stored(rows, order, out, start, bucket_rows, count), ROW).drop(ROW)


def number_by_position(
    df: DataFrame, position: str = "pos", out: str = "n", start: int = 1, width: int = BUCKET_ROWS
) -> DataFrame:
    """Number rows by a position of any orderable type, in ranges of about ``width`` rows, at most ``BUCKET_ROWS``."""
    return number_rows(df, position, out, start, min(width, BUCKET_ROWS))


def number_by_hash(
    df: DataFrame, key, seed: int | str = SEED, out: str = "n", limit: int | None = None
) -> DataFrame:
    """Number rows in hash order; with ``limit`` only the first rows remain.

    For a limit, rows beyond it are told by the first digits of their hash and dropped
    before anything is sorted or moved.
    """
    rows, h = df, hash_order(key, seed)
    if limit is not None:
        head = F.substring(h, 1, 3)
        # at most 4 096 different heads
        sizes = sorted((r[0], r[1]) for r in df.groupBy(head).count().collect() if r[0] is not None)
        last, held = "", 0
        for last, size in sizes:
            held += size
            if held >= limit:
                break
        rows = rows.where(h.isNull() | (head <= last))
    key_col = F.col(key) if isinstance(key, str) else key
    numbered = number_rows(rows, [h, key_col], out)
    return numbered if limit is None else numbered.where(F.col(out) <= limit)


def assign_ids(
    df: DataFrame, dataset, position: str, out: str, start: int = 1, width: int = BUCKET_ROWS
) -> DataFrame:
    """Sequential ids ``"<dataset>:<n>"`` in the order of a position."""
    numbered = number_by_position(df, position, "__n", start, width)
    return numbered.withColumn(out, make_id(dataset, "__n")).drop("__n")


def append_ids(existing: DataFrame, new: DataFrame, dataset, position: str, out: str) -> DataFrame:
    """Ids for ``new`` that continue after the rows of ``existing``."""
    count = existing.agg(F.count(F.lit(1))).scalar()
    numbered = number_by_position(new, position, "__n").withColumn("__n", F.col("__n") + count)
    return numbered.withColumn(out, make_id(dataset, "__n")).drop("__n")
