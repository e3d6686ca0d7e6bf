"""Streaming jobs over several micro-batches."""

from pyspark.sql import functions as F

from trovekit.streaming import metric_windows, new_candidates, search_stream, stream_code_join


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def source(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    parts = sorted(r.part for r in df.select("part").distinct().collect())
    for p in parts:
        df.where(F.col("part") == p).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_dropped(spark, tmp_path):
    # late rows are judged by the watermark of the batch before, so one batch lies between
    times = [("00:05", 1.0), ("03:00", 2.0), ("03:05", 1.0), ("00:06", 9.0), ("06:00", 3.0)]
    rows = [(i, f"2024-01-01 {t}:00", "m", v) for i, (t, v) in enumerate(times)]
    df = spark.createDataFrame(rows, "part int, t string, meter string, v double").withColumn("t", F.to_timestamp("t"))
    got = run(metric_windows(source(spark, df, tmp_path, "in"), "t", "meter", "v", "1 hour", "10 minutes"), tmp_path, "out")
    assert sorted((str(r.window_start), r.n, r["max"]) for r in got.collect()) == [
        ("2024-01-01 00:00:00", 1, 1.0),
        ("2024-01-01 03:00:00", 2, 2.0),
    ]


def test_first_seen_across_batches(spark, tmp_path):
    rows = [(0, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:01:00", "a"), (1, "2024-01-01 00:01:00", "b"), (2, "2024-01-01 00:02:00", "b")]
    df = spark.createDataFrame(rows, "part int, t string, key string").withColumn("t", F.to_timestamp("t"))
    got = run(new_candidates(source(spark, df, tmp_path, "in"), "t", "1 day"), tmp_path, "out")
    assert sorted(r.key for r in got.collect()) == ["a", "b"]


def test_search_stream_batches(spark, tmp_path):
    q = spark.createDataFrame([(i, f"q{i}", [1.0, float(i)]) for i in range(3)], "part int, qid string, embedding array<double>")
    pool = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "did string, embedding array<double>")
    out = str(tmp_path / "hits")
    stream = source(spark, q, tmp_path, "in").drop("part")
    search_stream(stream, pool, 1, out, out + "-log").awaitTermination()
    got = {r.qid: (r.did, r.batch_id) for r in spark.read.parquet(out).collect()}
    assert {k: v[0] for k, v in got.items()} == {"q0": "x", "q1": "x", "q2": "y"}
    assert len({v[1] for v in got.values()}) == 3


def test_a_key_is_new_again_when_its_state_has_expired(spark, tmp_path):
    hours = [0, 1, 2, 3, 4, 5, 9]
    rows = [(h, f"2024-01-01 0{h}:00:00", "often") for h in hours] + [(0, "2024-01-01 00:00:00", "late"), (9, "2024-01-01 09:00:00", "late")]
    df = spark.createDataFrame(rows, "part int, t string, key string").withColumn("t", F.to_timestamp("t"))
    stream = new_candidates(source(spark, df, tmp_path, "in"), "t", "1 hour")
    got = run(stream, tmp_path, "out")
    # the key of hour 4 is held until 5; when hour 9 comes the watermark has seen hour 4 only
    assert sorted((r.key, r.part) for r in got.collect()) == [("late", 0), ("late", 9), ("often", 0), ("often", 4)]


def test_a_hot_code_is_spread(spark, tmp_path):
    """A third of all candidates share one code: the join deals them over tasks and finds the same pairs."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 200 + 100).cast("int")
    codes = spark.range(9_000).select(F.array(F.lit(0), hot).alias("code"), F.concat(F.lit("d"), F.col("id")).alias("did"))
    beams = spark.createDataFrame([(i % 2, f"q{i}", [0, c]) for i, c in enumerate([7, 7, 7, 101, 150, 999])], "part int, qid string, code array<int>")
    plain = beams.join(codes, "code").select("qid", "did")
    for salt_rows in (100, 10**9):
        joined = stream_code_join(source(spark, beams, tmp_path, f"in{salt_rows}"), codes, salt_rows)
        got = run(joined, tmp_path, f"out{salt_rows}").select("qid", "did")
        assert sorted(got.collect()) == sorted(plain.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    tasks = stream_code_join(beams, codes, 100).groupBy(F.spark_partition_id()).count().collect()
    for name in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
        spark.conf.unset(f"spark.sql.{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = sorted(r["count"] for r in tasks)
    assert sum(sizes) == plain.count() and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_table_stream_reads_files_and_folders(spark, tmp_path):
    import checks.all_queries  # noqa: F401
    from checks.base import Tables
    from checks.q_streams import drain, table_stream

    rows = spark.range(60).selectExpr("id AS event_id")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "single"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "single").glob("*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for kind in ("folder", "file"):
        t = Tables(spark, str(tmp_path / kind))
        got = drain(table_stream(t, "events"), t, f"table-stream-{kind}")
        assert sorted(r.event_id for r in got.collect()) == list(range(60))


def test_dedup_hours_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    import checks.all_queries  # noqa: F401
    from checks import q_streams
    from checks.base import Tables

    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 900) AS text")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    intake = []
    real = q_streams.scratch_path
    monkeypatch.setattr(q_streams, "scratch_path", lambda s, label: (intake.append((label, real(s, label))), intake[-1][1])[1])
    rows = q_streams.stream_dedup(Tables(spark, str(tmp_path))).collect()
    files = spark.read.parquet(dict(intake)["intake"]).select(F.input_file_name()).distinct().count()
    assert files > q_streams.HOURS
    # hours 0 to 7 of a key: held until a batch whose watermark, two hours before its own, has passed its hour + 1
    want = set()
    for k in range(900):
        hours = sorted({d % 8 for d in range(k, 4000, 900)})
        last = None
        for h in hours:
            if last is None or h - 3 >= last + 1:
                want.add((k, h))
                last = h
    assert len(rows) == len(want)
    assert sorted(r.hour for r in rows) == sorted(h for _, h in want)


def test_code_join_keeps_its_partitions(spark):
    from trovekit.streaming import jobs

    codes = spark.createDataFrame([([i % 3], f"d{i}") for i in range(300)], "code array<int>, did string")
    beams = spark.createDataFrame([(f"q{i}", [i % 3]) for i in range(60)], "qid string, code array<int>")
    joined = jobs.stream_code_join(beams, codes.hint("merge"), salt_rows=10)
    assert joined.count() == joined.distinct().count() == 60 * 100
    # few bytes go in, many rows come out: every core has a part of the join
    assert joined.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_beams_meet_lists_of_stored_rows(spark, tmp_path):
    stored = [([i % 3], f"d{i % 90}" if i % 17 else None) for i in range(100)] + [(None, "x"), ([7], "y")]
    codes = spark.createDataFrame(stored, "code array<int>, did string")
    beams = spark.createDataFrame([(f"q{i}", [i % 4], 0) for i in range(40)] + [("q0", [0], 0), (None, None, 0)], "qid string, code array<int>, part int")
    plain = sorted((r.qid, str(r.did)) for r in beams.join(codes, "code").collect())
    for salt_rows in (10, 10**9):
        joined = stream_code_join(source(spark, beams, tmp_path, f"list-in{salt_rows}"), codes, salt_rows, members="stored")
        files = run(joined, tmp_path, f"list-out{salt_rows}")
        got = files.select("qid", F.inline("stored"))
        assert got.columns == ["qid", "did"] and sorted((r.qid, str(r.did)) for r in got.collect()) == plain
        assert files.count() <= 31 * (4 if salt_rows == 10 else 1)


def test_code_join_query_writes_no_row_per_pair(spark, tmp_path, monkeypatch):
    import random

    import checks.all_queries  # noqa: F401
    from checks import q_streams
    from checks.base import Tables

    random.seed(4)
    # most vectors are near one of two, so two codes hold much of the pool
    vectors = [(i, [float((i % 2) * 2 - 1) + random.random() / 50 for _ in range(64)] if i % 8 else [random.random() - 0.5 for _ in range(64)], i % 10) for i in range(600)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    written = []
    real = q_streams.drain
    monkeypatch.setattr(q_streams, "drain", lambda *a, **k: (written.append(real(*a, **k)), written[-1])[1])
    kept = []
    stages = q_streams._stages
    monkeypatch.setattr(q_streams, "_stages", lambda t: (kept.append(stages(t)), kept[-1])[1])
    rows = q_streams.stream_code_join_query(Tables(spark, str(tmp_path)))
    (codes, beams), found = kept[0], sorted(map(tuple, rows.collect()))
    pairs = beams.join(codes.select("code", "did"), "code").collect()
    assert found == sorted((r.qid, r.beam_rank, r.did, "-".join(map(str, r.code))) for r in pairs)
    assert rows.dtypes == [("qid", "string"), ("beam_rank", "bigint"), ("did", "string"), ("code", "string")]
    assert 5 * written[0].count() < len(found)
