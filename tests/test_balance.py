"""Numbering, skewed joins and chunked windows against their plain forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trovekit.operators import numbering, pools, sampling, skew, stats


def hot(spark, n=3000):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40)
    return spark.range(n).select(F.col("id").alias("pos"), key.alias("k"), (F.col("id") * 7 % 11).alias("v"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_numbering_is_dense_and_ordered(spark):
    df = hot(spark).withColumn("pos", F.col("pos") * 3 + 5)
    got = numbering.number_by_position(df, "pos", width=250, start=10).select("pos", "n")
    assert rows(got) == [(i * 3 + 5, i + 10) for i in range(3000)]


def test_numbering_ignores_partitioning(spark):
    df = hot(spark)
    a = rows(numbering.number_by_hash(df, "pos").select("pos", "n"))
    b = rows(numbering.number_by_hash(df.repartition(13, "v"), "pos").select("pos", "n"))
    assert a == b
    first = rows(numbering.number_by_hash(df, "pos", limit=100).select("pos", "n"))
    assert first == sorted(r for r in a if r[1] <= 100)


def test_ties_and_null_positions_spread(spark):
    """Nine rows of ten have no position: their range is cut by row, and the numbers stay dense."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("pos"), F.col("id").alias("v"))
    rows = numbering.stored_rows(df)
    numbered = numbering.number_stored(rows, ["pos"], "n", bucket_rows=4_000)
    sizes = [r["count"] for r in numbered.groupBy(F.floor((F.col("n") - 1) / 4_000)).count().collect()]
    assert sizes == [4_000] * 10
    got = numbering.number_rows(df, "pos", bucket_rows=4_000)
    assert got.columns == ["pos", "v", "n"]
    found = got.orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 40_001))
    assert [r.pos for r in found] == [None] * 36_000 + list(range(0, 40_000, 10))
    # what the ranges hold before they are numbered
    parts = rows.select(F.col("pos").alias("k"), numbering.ROW).repartitionByRange(10, "k", numbering.ROW)
    tasks = sorted(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
    assert len(tasks) == 10 and tasks[-1] <= 3 * tasks[5]


def test_only_keys_and_row_numbers_are_sorted(spark):
    df = spark.range(5_000).select(F.col("id").alias("pos"), F.repeat(F.lit("x"), 50).alias("text"))
    plan = numbering.number_rows(df, "pos", bucket_rows=500)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan.split("text")[0]
    assert not any("text" in line for line in plan.splitlines() if "Sort" in line and "SortMergeJoin" not in line)


def test_append_ids(spark):
    df = hot(spark, 10)
    got = numbering.append_ids(spark.range(4), df, 6, "pos", "did").orderBy("pos")
    assert [r.did for r in got.collect()] == [f"6:{i}" for i in range(5, 15)]


def test_skew_join_equals_join(spark):
    left = hot(spark)
    right = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("r"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = rows(left.join(right, "k", how).select(*(["k", "pos", "r"] if how in ("inner", "left") else ["k", "pos"])).fillna(-1))
        got = skew.skew_join(left, right, "k", how, slice_rows=100, sample=1)
        assert rows(got.select(*(["k", "pos", "r"] if how in ("inner", "left") else ["k", "pos"])).fillna(-1)) == plain, how


def test_skew_join_slices_hot_keys(spark):
    slices = {r.k: r["__slices"] for r in skew.hot_keys(hot(spark), ["k"], 100, sample=1).collect()}
    assert slices[0] >= 10 and len(slices) == 1


def test_sampled_hot_keys_find_the_hot_key(spark):
    found = skew.hot_keys(hot(spark, 60_000), ["k"], 10_000, ["pos"], sample=8).collect()
    assert [r.k for r in found] == [0]


def test_chunked_changes(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("pos")
    plain = df.withColumn("p", F.lag("v").over(w)).groupBy("k").agg(
        F.sum(F.coalesce((F.col("p") != F.col("v")).cast("long"), F.lit(0))).alias("c")
    )
    assert rows(skew.chunked_changes(df, "k", "pos", "v", width=37)) == rows(plain)


def test_chunked_changes_golden(spark):
    df = spark.createDataFrame([(0, "c", 1), (1, "c", 1), (2, "c", 2), (3, "c", 1)], "pos long, code string, id int")
    for width in (1, 2, 100):
        assert rows(skew.chunked_changes(df, "code", "pos", "id", width)) == [("c", 2)]


def test_chunked_running_sum(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("pos", F.sum("v").over(w).alias("s"))
    got = skew.chunked_running_sum(df, "k", "pos", F.col("v"), "s", width=41).select("pos", "s")
    assert rows(got) == rows(plain)


def test_rolling_meter_across_chunks(spark):
    df = hot(spark, 600).select(F.lit("m").alias("meter"), (F.col("pos") + 1).alias("n"), F.col("v").cast("double").alias("v"))
    whole = stats.rolling_meter(df, "meter", [], "v", window=5, width=10_000)
    chunked = stats.rolling_meter(df, "meter", [], "v", window=5, width=17)
    assert rows(whole) == rows(chunked)
    four = spark.createDataFrame([("m", i, float(i)) for i in (1, 2, 3, 4)], "meter string, n long, v double")
    last = stats.rolling_meter(four, "meter", [], "v", window=20).where("n = 4").first()
    assert (last.median, last["avg"], last["max"], last["last"]) == (2.0, 2.5, 4.0, 4.0)


def test_number_within(spark):
    df = hot(spark)
    got = stats.number_within(df, "k", F.floor(F.col("pos") / 100), ["pos"]).select("pos", "n")
    w = Window.partitionBy("k").orderBy("pos")
    assert rows(got) == rows(df.select("pos", F.row_number().over(w).cast("long").alias("n")))


def test_numbering_keeps_null_and_sparse_rows(spark):
    values = [None] * 40 + [i**3 for i in range(3000)] + [10**15 + i for i in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "p long, i long")
    got = numbering.number_rows(df, ["p", "i"], bucket_rows=100).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(values) + 1))
    assert [r.i for r in got] == sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))


def test_numbering_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(5000).mapInArrow(count, "id long")
    numbering.number_rows(df, "id", bucket_rows=500).collect()
    assert seen.value == 5000


def test_number_within_keeps_null_keys(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = stats.number_within(df, "k", F.when(F.col("v") > 50, F.floor(F.col("v") / 64)), ["v"])
    assert got.count() == 300 and got.where("k IS NULL").agg(F.max("n")).first()[0] == 100


def test_rolling_meter_wants_long_chunks(spark):
    with pytest.raises(ValueError):
        stats.rolling_meter(hot(spark, 10), "k", [], "v", window=20, width=10, position="pos")


def test_caps_of_large_and_small_groups(spark):
    """Groups above the limit of a task are cut into buckets; the rows chosen are the same."""
    group = F.when(F.col("id") % 10 < 7, F.lit(None).cast("string")).otherwise(F.concat(F.lit("g"), F.col("id") % 23))
    df = spark.range(6_000).select(F.col("id").alias("k"), group.alias("g"), (F.col("id") % 2).alias("h"))
    for limit in (1, 40, 5_000):
        plain = rows(sampling.cap_per_group(df, ["g", "h"], "k", limit).fillna("none"))
        cut = rows(sampling.cap_per_group(df, ["g", "h"], "k", limit, large_rows=50).fillna("none"))
        assert plain == cut and max(r[3] for r in plain) <= limit


def test_first_seen_moves_no_text_in_its_aggregate(spark):
    values = [(i % 40, None if i % 9 == 0 else 100 - i, f"text {i % 7} " * 20, f"rest {i}") for i in range(400)] + [(1, 5, "tie", "a"), (1, 5, "tie", "a")]
    df = spark.createDataFrame(values, "k long, pos long, txt string, other string")
    _, first = pools._first_rows(df, ["txt"], "pos")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    exchanged = [line for line in plan.splitlines() if "partial_" in line]
    assert exchanged and not any("txt" in line or "other" in line for line in exchanged)
    got = pools.first_seen(df, "txt", "pos")
    assert got.columns == df.columns
    want = {}
    for r in sorted(values, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(r[2], r[1])
    assert {r.txt: r.pos for r in got.collect()} == want and got.count() == len(want)
    composite = pools.first_seen_numbered(df, ["txt"], ["k", "pos"], ["k", "pos"])
    found = composite.orderBy("__n").collect()
    assert [r["__n"] for r in found] == list(range(1, len(want) + 1))
    assert [(r.k, r.pos is not None, r.pos or 0) for r in found] == sorted((r.k, r.pos is not None, r.pos or 0) for r in found)


def test_later_duplicates_move_no_key(spark):
    values = [(i, f"text {i % 7} " * 20 if i % 5 else "", None, "en" if i % 2 else "de") for i in range(1, 200)]
    values = [r for r in values if r[1]] + [(3, "text 3 " * 20, None, "en"), (500, "-", None, "en"), (501, "-", None, None)]
    pool = spark.createDataFrame(values, "pos long, txt string, img_path string, modality string")
    found = pools.duplicate_candidates(pool)
    assert found.columns == ["key", "pos", "txt", "img_path", "modality"]
    first = {}
    for pos, txt, _, kind in sorted(values, key=lambda r: r[0]):
        first.setdefault((txt, kind), pos)
    want = sorted((pos, txt, kind) for pos, txt, _, kind in values if pos > first[txt, kind])
    assert sorted((r.pos, r.txt, r.modality) for r in found.collect()) == want
    assert all(r.key == f"{r.txt}-{r.modality}" for r in found.collect())
    plan = found.select("pos", "modality")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("key#" in line for line in dealt)
    # the text is hashed before the shuffle and goes no further
    assert all("txt" not in line for line in plan.splitlines() if "SortMergeJoin" in line or "Sort [" in line or "partial_min" in line)


def test_first_seen_in_place(spark, monkeypatch):
    from trovekit.operators import numbering

    stored = []
    real = numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df, label: (stored.append(label), real(df, label))[1])
    values = [(None if i % 11 == 0 else i % 40, None if i % 9 == 0 else 100 - i % 90, f"rest {i}") for i in range(800)]
    values += [(7, 100 + i, "of a key that holds much") for i in range(5000)] + [(7, 12, "tie"), (7, 12, "tie")] + [(None, 50 + i, "no key") for i in range(4000)]
    df = spark.createDataFrame(values, "k long, pos long, other string").repartition(6)
    want = {}
    for k, pos, _ in sorted(values, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(k, pos)
    known = {(k, pos, other) for k, pos, other in values}
    plain = pools.first_seen(df, "k", "pos", stored=False)
    thinned = pools._first_in_place(df, "k", "pos", 500)  # with keys that count as hot
    plan = thinned._jdf.queryExecution().optimizedPlan().toString()
    assert "__least" in plan and "__least" not in plain._jdf.queryExecution().optimizedPlan().toString()
    for got in (plain, thinned):
        assert got.columns == df.columns
        rows_ = got.collect()
        assert {r.k: r.pos for r in rows_} == want and len(rows_) == len(want)
        assert all(tuple(r) in known for r in rows_)
    assert not stored


def test_linked_questions_move_once(spark, monkeypatch):
    from trovekit.operators import convert, numbering

    labels, frames = [], []
    real = numbering.materialize
    keep = lambda df, label: (labels.append(label), frames.append(df), real(df, label))[2]
    monkeypatch.setattr(numbering, "materialize", keep)
    monkeypatch.setattr(convert, "materialize", keep)
    monkeypatch.setattr(pools, "materialize", keep)
    asked = [(i, f"q{i % 150}", "what?" if i % 7 else "", [f"a{i % 5}"], [f"b{i % 3}"]) for i in range(300)]
    questions = spark.createDataFrame(asked, "pos long, data_id string, question string, answer array<string>, answer_eval array<string>")
    entity = spark.createDataFrame([(f"q{i}", f"e{i % 10}") for i in range(150)], "data_id string, entity_id string")
    kinds = spark.createDataFrame([(f"q{i}", f"t{i % 4}") for i in range(0, 150, 2)], "data_id string, question_type string")
    articles = spark.createDataFrame([(f"e{i}", f"holds a{i % 5}" if i % 2 else "b0 too") for i in range(10)], "entity_id string, content string")
    kept = convert.answerable_questions(questions, entity, articles, kinds)
    text = {f"e{i}": f"holds a{i % 5}" if i % 2 else "b0 too" for i in range(10)}
    want = []
    for pos, key, question, answer, more in asked[:150]:
        i = int(key[1:])
        if question and any(a in text[f"e{i % 10}"] for a in answer + more):
            want.append((pos, key, f"e{i % 10}", f"t{i % 4}" if i % 2 == 0 else None))
    assert sorted((r.pos, r.data_id, r.entity_id, r.question_type) for r in kept.collect()) == sorted(want, key=lambda r: r[0])
    # questions are not written before they are linked, and are dealt once, by the key of both joins
    assert labels == ["linked", "answers-held"]
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") <= 3
