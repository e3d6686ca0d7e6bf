"""Which files an evaluation needs: datasets, pools, judgements and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovekit import constants as K


def pool_file_stem(pool) -> Column:
    """Lower-cased pool name, with the ``_test`` suffix some pools carry."""
    name = F.lower(F.col(pool) if isinstance(pool, str) else pool)
    return F.when(name.isin(K.TEST_SUFFIX_POOLS), F.concat(name, F.lit("_test"))).otherwise(name)


def metric_depths(metrics) -> Column:
    """``"Recall@1, Recall@5"`` -> ``[1, 5]``."""
    c = F.col(metrics) if isinstance(metrics, str) else metrics
    recalls = F.filter(F.split(c, ","), lambda m: F.lower(m).contains("recall"))
    return F.transform(recalls, lambda m: F.split_part(F.trim(m), F.lit("@"), F.lit(2)).cast("int"))


def max_depth(metrics) -> Column:
    return F.array_max(metric_depths(metrics))


def catalog(spark: SparkSession, config: dict) -> DataFrame:
    """One row per (split, dataset, pool, qrel, metrics).

    ``config`` maps a split to four lists of equal length: ``datasets``,
    ``pools``, ``qrels`` and ``metrics``.
    """
    rows = []
    for split, lists in config.items():
        names = [lists[k] for k in ("datasets", "pools", "qrels", "metrics")]
        if len({len(n) for n in names}) != 1:
            raise ValueError(f"datasets, pools, qrels and metrics of {split!r} differ in length")
        rows += [(split, *row) for row in zip(*names)]
    df = spark.createDataFrame(rows, "split string, dataset string, pool string, qrel string, metrics string")
    return resolve(df)


def resolve(df: DataFrame, prefix: str = "") -> DataFrame:
    """File names of the queries, the pool and the judgements of each row."""
    dataset, qrel = F.lower("dataset"), F.lower("qrel")
    stem = pool_file_stem("pool")
    pool_file = F.when(
        stem == "union", F.concat(F.lit(f"union_pool/{prefix}union_"), F.col("split"), F.lit("_cand_pool.jsonl"))
    ).otherwise(F.concat(F.lit(f"local/{prefix}"), stem, F.lit("_cand_pool.jsonl")))
    return df.select(
        dataset.alias("dataset"),
        "split",
        stem.alias("pool"),
        qrel.alias("qrel"),
        metric_depths("metrics").alias("depths"),
        max_depth("metrics").alias("k"),
        F.concat(F.col("split"), F.lit(f"/{prefix}"), dataset, F.lit("_"), F.col("split"), F.lit(".jsonl")).alias(
            "query_file"
        ),
        pool_file.alias("pool_file"),
        F.concat(
            F.lit("qrels/"), F.col("split"), F.lit(f"/{prefix}"), qrel, F.lit("_"), F.col("split"), F.lit("_qrels.txt")
        ).alias("qrel_file"),
    )
