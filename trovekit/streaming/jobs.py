"""Streaming jobs over file, table or message sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovekit.operators.blocks import pack_pool
from trovekit.operators.search import top_k
from trovekit.session import materialize

#: stored rows of a code that one task joins
SALT_ROWS = 500_000


def search_stream(
    queries: DataFrame, pool: DataFrame, k: int, output: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Stream of query vectors x stored pool -> top k per query.

    Each micro-batch is one exact search; the pool is packed into blocks once, when
    the stream is defined, and every batch reads those.  Results go to ``output`` under
    ``batch_id=<n>``; a replayed batch overwrites its own folder only.
    """

    packed = pack_pool(pool, queries)

    def handle(batch: DataFrame, batch_id: int) -> None:
        result = top_k(batch, pool, k, packed_pool=packed, **options)
        result.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = queries.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_code_join(beams: DataFrame, codes: DataFrame, salt_rows: int = SALT_ROWS, members: str | None = None) -> DataFrame:
    """Stream of generated codes joined with the stored code table (code, did and more).

    A stored code of more than ``salt_rows`` rows is dealt over salts by the hash of
    its rows, as many as its count asks for, and a beam is sent to every salt of its
    code; so a code that holds much of the pool is spread in every micro-batch.  The
    table of such codes has fewer than one row for each ``salt_rows`` stored rows.

    A beam and a stored row of its code are a row of the result.  With ``members`` a beam
    and a salt are one, and all stored rows met there a list of structs of that name:
    files of a stream hold the pairs, which grow with the square of a code, but no row for each.
    """
    rest = [c for c in codes.columns if c != "code"]
    listed = F.collect_list(F.struct(*rest)).alias(members or "members")
    counted = codes.groupBy("code").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > salt_rows)
    hot = materialize(counted.select("code", F.ceil(F.col("__n") / salt_rows).cast("int").alias("__salts")), "hot-codes")
    if hot.isEmpty():
        return beams.join(codes.groupBy("code").agg(listed) if members else codes, "code")
    hot = F.broadcast(hot)
    one = F.coalesce("__salts", F.lit(1))
    stored = codes.join(hot, "code", "left").withColumn("__salt", F.pmod(F.xxhash64(*rest), one).cast("int")).drop("__salts")
    sent = beams.join(hot, "code", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__salts")
    # the join makes many more rows than it reads, so its partitions are not merged by their bytes
    parts = int(beams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent, stored = (side.repartition(parts, "code", "__salt") for side in (sent, stored))
    if members:
        stored = stored.groupBy("code", "__salt").agg(listed)
    return sent.join(stored, ["code", "__salt"]).drop("__salt")


def new_candidates(candidates: DataFrame, event_time: str, delay: str, key: str = "key") -> DataFrame:
    """First occurrence of each candidate key.

    A key is held until the watermark, the latest event time less ``delay``, passes
    its first event time plus ``delay``; a key that comes again after that is new.
    """
    return candidates.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def metric_windows(
    events: DataFrame, event_time: str, meter: str, value: str, width: str, delay: str
) -> DataFrame:
    """Count, mean and largest value per meter and event-time window.

    Rows later than ``delay`` are dropped by the watermark.
    """
    timed = events.withColumn("__t", F.col(event_time).cast("timestamp")).withWatermark("__t", delay)
    return timed.groupBy(F.window("__t", width).alias("w"), F.col(meter)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max")
    ).select(F.col("w.start").alias("window_start"), meter, "n", "avg", "max")
