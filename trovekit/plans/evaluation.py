"""Evaluation from files to files: stored queries, pools, vectors and judgements to run files and a result table.

All rows of the catalog are one job: every kind of file is one scan over all the
names the catalog holds, searches are keyed by the pool, and all runs are written
at once.  The plan has the same size whatever the number of rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovekit import schemas
from trovekit.functions.ids import hash_did, hash_qid
from trovekit.operators.blocks import top_k_of_pools
from trovekit.operators.evaluate import hit_counts, hit_rates, ordered_results, result_rows
from trovekit.sources.catalog import catalog
from trovekit.sources.records import source_name
from trovekit.sources.stores import read_embeddings
from trovekit.sources.tables import write_tsv
from trovekit.sources.trec import read_qrels, read_run, run_name, write_runs


def _scanned(spark: SparkSession, data: str, names: list[str], schema, key: str) -> DataFrame:
    """(source, key) of the records of all ``names`` below ``data``."""
    paths = [os.path.join(data, n) for n in names]
    return spark.read.schema(schema).json(paths).select(source_name(data, names[0].count("/") + 1).alias("source"), key)


def stored_vectors(spark: SparkSession, store: str, stored_as: dict[str, str], records: DataFrame, key: str) -> DataFrame:
    """(source, key, embedding) of ``records`` (source, key); a record without a stored vector fails the job.

    ``stored_as`` names the stored pool of each source.
    """
    hashed = hash_qid(key) if key == "qid" else hash_did(key)
    names = F.broadcast(spark.createDataFrame(list(stored_as.items()), "source string, pool string"))
    ids = records.join(names, "source").select("source", "pool", key, hashed.alias("id"))
    vectors = read_embeddings(spark, store).where(F.col("pool").isin(*stored_as.values())).select("pool", "id", "embedding")
    found = ids.join(vectors, ["pool", "id"], "left")
    missing = F.raise_error(F.concat(F.lit("no vector in "), F.col("pool"), F.lit(" for "), F.col(key)))
    return found.select("source", key, F.coalesce("embedding", missing.cast("array<float>")).alias("embedding"))


def evaluate_from_files(
    spark: SparkSession, data: str, store: str, config: dict, out: str, search=top_k_of_pools, pool_store: Callable[[str], str] = str
) -> DataFrame:
    """Run every row of the catalog ``config`` and write what it finds.

    ``data`` holds the query, pool and judgement files the catalog names; ``store``
    holds vectors written by ``write_embeddings`` under ``<dataset>_<split>`` and, for
    a pool, under ``pool_store(name)``.  ``search`` maps (queries, pools, searches) to
    the runs of all searches as ``top_k_of_pools`` does, so codes can take the place of
    vectors.  Writes ``<out>/run_files/<name>_run.txt`` per (dataset, pool) and
    ``<out>/results.tsv``; returns the results read from the written runs.
    """
    rows = catalog(spark, config).collect()  # configuration
    names = [run_name(r.dataset, r.pool, r.split, r.k) for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("two rows of the catalog have the same dataset, pool, split and depth")
    searches = spark.createDataFrame(
        [(n, r.query_file, r.pool_file, r.k, r.qrel_file, r.dataset, r.split, r.pool, list(r.depths)) for n, r in zip(names, rows)],
        "search string, qset string, pool string, k int, qrels string, dataset string, split string, name string, depths array<int>",
    )
    each = lambda column: sorted({r[column] for r in rows})
    queries = _scanned(spark, data, each("query_file"), schemas.QUERY, "qid")
    pools = _scanned(spark, data, each("pool_file"), schemas.CANDIDATE, "did")
    run = search(
        stored_vectors(spark, store, {r.query_file: f"{r.dataset}_{r.split}" for r in rows}, queries, "qid").withColumnRenamed("source", "qset"),
        stored_vectors(spark, store, {r.pool_file: pool_store(r.pool) for r in rows}, pools, "did").withColumnRenamed("source", "pool"),
        searches.select("search", "qset", "pool", "k"),
    )
    files = each("qrel_file")
    judged = read_qrels(spark, [os.path.join(data, f) for f in files], source_name(data, files[0].count("/") + 1))
    judged = judged.join(F.broadcast(searches.select("search", F.col("qrels").alias("source"))), "source").drop("source")
    tasks = judged.groupBy("search", "qid").agg(F.min_by("task_id", "pos").alias("task_id"))
    tagged = run.join(tasks, ["search", "qid"]).withColumnRenamed("search", "run_id")
    folder = os.path.join(out, "run_files")
    paths = write_runs(tagged, folder, names)
    file = F.regexp_replace(source_name(folder, 1), "_run\\.txt$", "")
    written = read_run(spark, list(paths.values()), source=file).withColumnRenamed("source", "search")
    depths = sorted({d for r in rows for d in r.depths})
    counts = hit_rates(hit_counts(written, judged, depths, ["search"]), depths)
    labelled = counts.join(F.broadcast(searches.drop("pool", "k").withColumnRenamed("name", "pool")), "search")
    # a row reports the depths it asks for
    asked = {f"Recall@{d}": F.when(F.array_contains("depths", d), F.col(f"`Recall@{d}`")) for d in depths}
    table = result_rows(labelled.withColumns(asked))
    write_tsv(ordered_results(table), os.path.join(out, "results.tsv"))
    return table
