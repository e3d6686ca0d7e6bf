"""Searches of many pools at once against one search per pool, and an evaluation whose plan does not grow."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovekit import schemas
from trovekit.functions.ids import hash_did, hash_qid
from trovekit.operators.blocks import top_k_of_pools
from trovekit.operators.search import top_k
from trovekit.plans.evaluation import evaluate_from_files
from trovekit.sources import records, stores, trec


def vectors(spark, names, key, rows, seed):
    rng = np.random.default_rng(seed)
    out = []
    for s, name in enumerate(names):
        for i in range(rows * (s + 1)):
            out.append((name, f"{s}:{i + 1}", [float(x) for x in rng.normal(size=8).round(2)]))
    return spark.createDataFrame(out, f"{key} string, {'qid' if key == 'qset' else 'did'} string, embedding array<float>")


@pytest.mark.parametrize("limits", [{}, {"group_rows": 16, "slice_rows": 32}, {"sent_bytes": 0}])
def test_searches_equal_one_search_each(spark, limits):
    queries, pools = vectors(spark, ["a", "b"], "qset", 20, 1), vectors(spark, ["x", "y", "z"], "pool", 60, 2)
    wanted = [("1", "a", "x", 3), ("2", "a", "z", 7), ("3", "b", "x", 1), ("4", "b", "y", 200), ("5", "a", "none", 3), ("6", "none", "x", 3)]
    searches = spark.createDataFrame(wanted, "search string, qset string, pool string, k int")
    got = {tuple(r) for r in top_k_of_pools(queries, pools, searches, **limits).select("search", "qid", "did", "score", "rank").collect()}
    want = set()
    for name, qset, pool, k in wanted:
        one = top_k(queries.where(F.col("qset") == qset).drop("qset"), pools.where(F.col("pool") == pool).drop("pool"), k)
        want |= {(name, r.qid, r.did, r.score, r.rank) for r in one.collect()}
    assert got == want


def test_empty_sides(spark):
    queries, pools = vectors(spark, ["a"], "qset", 3, 1), vectors(spark, ["x"], "pool", 3, 2)
    searches = spark.createDataFrame([("1", "a", "x", 3)], "search string, qset string, pool string, k int")
    for limits in ({}, {"sent_bytes": -1}):
        assert top_k_of_pools(queries.limit(0), pools, searches, **limits).count() == 0
        assert top_k_of_pools(queries, pools.limit(0), searches, **limits).count() == 0
        assert top_k_of_pools(queries, pools, searches.limit(0), **limits).count() == 0


def written_collection(spark, folder, n):
    """n data sets with a query file, a pool, judgements and vectors each, and a union pool."""
    data, store, rng = os.path.join(folder, "data"), os.path.join(folder, "store"), np.random.default_rng(n)
    empty = F.array().cast("array<string>")
    null = lambda c: F.lit(None).cast("string").alias(c)
    union = []
    for s in range(n):
        name = f"set{s}"
        q = [(f"1:{s * 100 + i + 1}", [float(x) for x in rng.normal(size=4)]) for i in range(6)]
        d = [(f"2:{s * 100 + i + 1}", [float(x) for x in rng.normal(size=4)]) for i in range(9)]
        union += d
        queries, pool = spark.createDataFrame(q, "qid string, embedding array<float>"), spark.createDataFrame(d, "did string, embedding array<float>")
        rows = queries.select("qid", F.lit("q").alias("query_txt"), null("query_img_path"), null("query_modality"), null("query_src_content"), empty.alias("pos_cand_list"), empty.alias("neg_cand_list"))
        records.write_jsonl(rows.coalesce(1), f"{data}/test/{name}_test.jsonl")
        records.write_jsonl(pool.select("did", F.lit("c").alias("txt"), null("img_path"), null("modality"), null("src_content")).coalesce(1), f"{data}/local/{name}_cand_pool.jsonl")
        judged = spark.createDataFrame([(a[0], b[0], 1, s % 3) for a, b in zip(q, d)], "qid string, did string, relevance int, task_id int")
        trec.qrel_lines(judged.coalesce(1)).write.text(f"{data}/qrels/test/{name}_test_qrels.txt")
        stores.write_embeddings(queries.select(hash_qid("qid").alias("id"), "embedding").coalesce(1), store, f"{name}_test")
        stores.write_embeddings(pool.select(hash_did("did").alias("id"), "embedding").coalesce(1), store, name)
    pool = spark.createDataFrame(union, "did string, embedding array<float>")
    records.write_jsonl(pool.select("did", F.lit("c").alias("txt"), null("img_path"), null("modality"), null("src_content")), f"{data}/union_pool/union_test_cand_pool.jsonl")
    stores.write_embeddings(pool.select(hash_did("did").alias("id"), "embedding"), store, "union")
    names = [f"set{s}" for s in range(n)]
    lists = {"datasets": names + names[:1], "pools": [*names, "union"], "qrels": names + names[:1], "metrics": ["Recall@1, Recall@5"] * n + ["Recall@1"]}
    return data, store, {"test": lists}


def counted(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, jobs


def test_evaluation_does_not_grow_with_the_catalog(spark, tmp_path):
    jobs = {}
    # Spark lists more than 32 folders in a job of its own; the count is about the work
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "1000")
    for n in (2, 29):
        data, store, config = written_collection(spark, str(tmp_path / f"n{n}"), n)
        out = str(tmp_path / f"out{n}")
        table, jobs[n] = counted(spark, f"eval-{n}", lambda: evaluate_from_files(spark, data, store, config, out))
        got = {(r.Dataset, r.CandPool): r for r in table.collect()}
        assert len(got) == n + 1
        # each row equals a search of its own
        for name, pool in (("set0", "set0"), ("set0", "union"), (f"set{n - 1}", f"set{n - 1}")):
            q = stores.read_embeddings(spark, store, f"{name}_test").select(F.concat(F.lit("1:"), F.col("id") - 500_000).alias("qid"), "embedding")
            d = stores.read_embeddings(spark, store, pool).select(F.concat(F.lit("2:"), F.col("id") - 20_000_000).alias("did"), "embedding")
            right = trec.read_qrels(spark, f"{data}/qrels/test/{name}_test_qrels.txt").select("qid", F.col("did").alias("good"))
            hits = top_k(q, d, 5).join(right, "qid").where("did = good")
            row = got[(name, pool)]
            assert row["Recall@1"] == round(hits.where("rank = 1").count() / 6, 4)
            assert row["Recall@5"] == (None if pool == "union" else round(hits.count() / 6, 4))
        assert sorted(f for f in os.listdir(f"{out}/run_files") if not f.startswith(".")) == sorted(
            f"{trec.run_name(*x)}_run.txt" for x in [(f"set{s}", f"set{s}", "test", 5) for s in range(n)] + [("set0", "union", "test", 1)]
        )
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.threshold")
    assert jobs[2] == jobs[29]


def test_two_rows_of_one_name_fail(spark, tmp_path):
    data, store, config = written_collection(spark, str(tmp_path), 1)
    for k in config["test"]:
        config["test"][k].append(config["test"][k][-1])
    with pytest.raises(ValueError, match="same dataset"):
        evaluate_from_files(spark, data, store, config, str(tmp_path / "out"))


def test_source_names(spark, tmp_path):
    root = str(tmp_path / "a+b c%d")
    records.write_jsonl(spark.createDataFrame([("x", None)], schemas.T.StructType([schemas.T.StructField(c, schemas.T.StringType()) for c in ("did", "txt")])), f"{root}/in/one.jsonl")
    found = spark.read.json(f"{root}/in/one.jsonl").select(records.source_name(root, 2).alias("s"), records.source_name(root, 1).alias("t")).collect()
    assert [tuple(r) for r in found] == [("in/one.jsonl", "in")]
