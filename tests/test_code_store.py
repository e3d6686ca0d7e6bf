"""Re-ranking over vectors stored by their codes."""

import random

import pytest
from pyspark.sql import functions as F

from trovekit.operators import code_search
from trovekit.sources import stores


@pytest.mark.parametrize("slice_rows", [10**6, 40])
def test_stored_form_equals_the_plain_one(spark, tmp_path, slice_rows):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    pool = [(f"d{i}", [0, 1] if i % 3 == 0 else [rng.randrange(4), rng.randrange(9)], vector()) for i in range(900)]
    held = spark.createDataFrame(pool, "did string, code array<int>, embedding array<float>")
    beams = spark.createDataFrame([(f"q{i}", c) for i in range(20) for c in ([0, 1], [1, i % 9], [2, 3], [7, 7])], "qid string, code array<int>")
    queries = spark.createDataFrame([(f"q{i}", vector()) for i in range(20)], "qid string, embedding array<float>")
    codes, vectors = held.select("code", "did"), held.select("did", "embedding")
    path = str(tmp_path / "by code")
    stores.write_vectors_by_code(codes, vectors, path, buckets=6, slice_rows=slice_rows)
    stores.write_vectors_by_code(codes, vectors, path, buckets=6, slice_rows=slice_rows)  # again: replaced
    stored = stores.read_vectors_by_code(spark, path)
    assert stored.count() == 900 and spark.sql("SHOW TABLES").where(F.col("tableName").startswith("trovekit_")).isEmpty()
    hot = stored.where(F.col("code") == F.array(F.lit(0), F.lit(1))).select("slice").distinct().count()
    assert (hot > 5) == (slice_rows == 40)
    got = code_search.rerank_stored(beams, stored, queries, 15)
    want = code_search.rerank(beams, codes, queries, vectors, 15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 300
    # the pool is not moved: below its scan there is no exchange before the join
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin") :]
    right = below[below.rindex("FileScan parquet spark_catalog") - 400 : below.rindex("FileScan parquet spark_catalog")]
    assert "Exchange" not in right and "Bucketed: true" in below


def test_queries_go_to_places_not_to_slices(spark, tmp_path, monkeypatch):
    """A code has as many places as its share of the pool fills buckets; blocks of a few rows give what whole ones give."""
    monkeypatch.setattr(stores, "BLOCK_ROWS", 7)
    monkeypatch.setattr(code_search, "BLOCK_ROWS", 5)
    rng = random.Random(5)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    pool = [(f"d{i}", [0] if i % 2 == 0 else [1 + i % 13], vector()) for i in range(520)]
    held = spark.createDataFrame(pool, "did string, code array<int>, embedding array<float>")
    beams = spark.createDataFrame([(f"q{i}", [c]) for i in range(40) for c in {0, i % 14, 99}], "qid string, code array<int>")
    queries = spark.createDataFrame([(f"q{i}", vector()) for i in range(40)], "qid string, embedding array<double>")
    codes, vectors = held.select("code", "did"), held.select("did", "embedding")
    again = codes.where("did < 'd2'")  # candidates stored twice must not fill a list twice
    path = str(tmp_path / "places")
    stores.write_vectors_by_code(codes.unionByName(again), vectors, path, buckets=8, slice_rows=3)
    stored = stores.read_vectors_by_code(spark, path)
    counted = {tuple(r.code): r for r in stored.groupBy("code").agg(F.count_distinct("slice").alias("slices"), F.count_distinct("key").alias("keys")).collect()}
    assert all(r.slices > 4 for r in counted.values())
    assert 4 <= counted[(0,)].keys <= 5 and all(r.keys == 1 for code, r in counted.items() if code != (0,))
    got = code_search.rerank_stored(beams, stored, queries, 9)
    want = code_search.rerank(beams, codes, queries, vectors, 9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 360
