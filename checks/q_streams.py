"""Structured Streaming jobs, run to the end of their input."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from checks.base import query, unit
from checks.q_codes import DECODED, NEED, _stages, joined
from trovekit.session import materialize, scratch_path
from trovekit.streaming import metric_windows, new_candidates, search_stream, stream_code_join


def table_stream(t, name):
    # the table may be one file or a folder of part files; a plain path would have to be a folder, a pattern may be either
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parque[t]")


def run_into(stream, out, log, mode="append"):
    """Run a stream over the input there is and it has not seen, into files."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def drain(stream, t, label, mode="append"):
    """Run a stream over all input into files and read them."""
    out = scratch_path(t.spark, label)
    run_into(stream, out, scratch_path(t.spark, f"{label}-log"), mode)
    return t.spark.read.schema(stream.schema).parquet(out)


@contextmanager
def one_batch_a_run(spark):
    """Runs end with their last batch of rows; the watermark moves on with the next run's batch."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query(
    f"""
WITH u AS (SELECT vec_id, {unit('embedding')} AS u FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS did, round(list_dot_product(a.u, b.u), 6) AS score FROM u a, u b)
SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM p QUALIFY rank <= 5
"""
)
def stream_topk(t):
    queries = table_stream(t, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    pool = t.embeddings.select(F.col("vec_id").alias("did"), "embedding")
    out = scratch_path(t.spark, "stream-topk")
    search_stream(queries, pool, 5, out, scratch_path(t.spark, "stream-topk-log")).awaitTermination()
    rows = t.spark.read.schema("qid long, did long, score double, rank int").parquet(out)
    return rows.select("qid", "did", "score", F.col("rank").cast("long").alias("rank"))


@query(needs=NEED, sql=DECODED + "SELECT b.qid, b.beam_rank, c.did, array_to_string(b.code, '-') AS code FROM beams b JOIN codes c ON b.code = c.code")
def stream_code_join_query(t):
    codes, beams = _stages(t)
    path = scratch_path(t.spark, "beam-source")
    beams.write.parquet(path)
    stream = t.spark.readStream.schema(beams.schema).parquet(path)
    # a code is spelled once a beam, and the stream's files hold no column that nothing reads
    stream = stream.select("qid", F.col("beam_rank").cast("long").alias("beam_rank"), "code", joined("code").alias("spelled"))
    # few rows to a salt, so frequent codes are dealt over several
    found = stream_code_join(stream, codes.select("code", "did"), salt_rows=20, members="stored")
    rows = drain(found.select("qid", "beam_rank", "stored", F.col("spelled").alias("code")), t, "stream-codes")
    return rows.select("qid", "beam_rank", F.inline("stored"), "code")


HOURS = 8


@query(
    f"""
WITH RECURSIVE arrived AS (
  SELECT DISTINCT md5(text) AS key, doc_id % {HOURS} AS hour FROM documents
), admitted AS (
  SELECT key, min(hour) AS hour FROM arrived GROUP BY key
  UNION
  -- a key of hour h is held until a batch ends whose watermark, two hours before its own, has passed h + 1
  SELECT a.key, min(n.hour) OVER (PARTITION BY a.key, a.hour) FROM admitted a JOIN arrived n ON n.key = a.key AND n.hour - 1 - 1 - 1 >= a.hour + 1
)
SELECT key, hour FROM admitted
"""
)
def stream_dedup(t):
    # one slice of the documents an hour; a key is held for an hour beyond the watermark and is new again after that
    path, out, log = (scratch_path(t.spark, label) for label in ("intake", "stream-dedup", "stream-dedup-log"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hour = (F.col("doc_id") % HOURS).alias("hour")
    timed = t.documents.select(F.md5("text").alias("key"), hour, F.timestamp_add("HOUR", hour.cast("int"), start).alias("ts"))
    timed = materialize(timed, "timed")  # the texts are read once
    # each hour's files, however many, are one batch: the stream goes on where it stopped before them
    with one_batch_a_run(t.spark):
        for h in range(HOURS):
            timed.where(F.col("hour") == h).write.mode("append").parquet(path)
            found = new_candidates(t.spark.readStream.schema(timed.schema).parquet(path), "ts", "1 hour")
            run_into(found, out, log)
    return t.spark.read.schema(found.schema).parquet(out).select("key", "hour")


@query(
    """
WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, value FROM events)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max
FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
"""
)
def stream_meter(t):
    stream = metric_windows(table_stream(t, "events"), "ts", "event_type", "value", "1 hour", "10 minutes")
    rows = drain(stream, t, "stream-meter")
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("avg", 6).alias("avg"), "max"
    )
