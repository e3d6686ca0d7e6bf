"""Hit rates, error types and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovekit import constants as K
from trovekit.functions.ids import dataset_domain, dataset_name, task_modalities, task_name
from trovekit.operators.links import POS
from trovekit.sources.trec import task_of_query


def rate(hits: str, total: str) -> Column:
    """hits / total to four digits, exact half-even; NULL for a zero total."""
    h, n = F.col(hits).cast("long"), F.col(total).cast("long")
    scaled = h * 10_000
    rest = F.try_mod(scaled, n)
    whole = F.try_divide(scaled - rest, n).cast("long")
    up = (2 * rest > n) | ((2 * rest == n) & (whole % 2 == 1))
    return F.when(n > 0, (whole + up.cast("long")) / 10_000.0)


def first_relevant(
    run: DataFrame, qrels: DataFrame, by: list[str] | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Per judged query (and ``by``): task id and rank of its first relevant hit.

    Queries without judgement are left out; ``unjudged`` counts them.  ``asked``
    (``by`` columns and qid) adds queries that retrieved nothing at all; without
    it only queries with a result are known.
    """
    by = by or []
    scope = [c for c in by if c in qrels.columns]
    # The run is read once: judgements are attached, then reduced per query.
    relevant = qrels.select(*scope, "qid", "did").distinct().withColumn("__hit", F.lit(True))
    judged = run.select(*by, "qid", "did", "rank").join(relevant, [*scope, "qid", "did"], "left")
    best = judged.groupBy(*by, "qid").agg(F.min(F.when(F.col("__hit"), F.col("rank"))).alias("first_rank"))
    tasks = qrels.groupBy(*scope, "qid").agg(F.min_by("task_id", "pos").alias("task_id"))
    if asked is not None:
        best = asked.select(*by, "qid").join(best, [*by, "qid"], "left")
    return best.join(tasks, [*scope, "qid"])


def unjudged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Number of retrieved queries without any judgement."""
    return run.select("qid").distinct().join(qrels.select("qid").distinct(), "qid", "left_anti").agg(
        F.count(F.lit(1)).alias("unjudged")
    )


def hit_counts(
    run: DataFrame, qrels: DataFrame, ks: list[int], by: list[str] | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Per task (and ``by``): queries ``n`` and hits at every depth.

    A hit means at least one relevant candidate in the first k.
    """
    by = by or []
    per_query = first_relevant(run, qrels, by, asked)
    hits = [F.sum(F.coalesce((F.col("first_rank") <= k).cast("long"), F.lit(0))).alias(f"hits_{k}") for k in ks]
    return per_query.groupBy("task_id", *by).agg(F.count(F.lit(1)).alias("n"), *hits)


def hit_rates(counts: DataFrame, ks: list[int]) -> DataFrame:
    """Add ``Recall@k`` columns to hit counts."""
    for k in ks:
        counts = counts.withColumn(f"Recall@{k}", rate(f"hits_{k}", "n"))
    return counts


def result_rows(rates: DataFrame) -> DataFrame:
    """Wide result rows: TaskID, Task, Dataset, Split, CandPool, metrics."""
    metrics = [c for c in K.RESULT_METRICS + K.ERROR_METRICS if c in rates.columns]
    return rates.select(
        F.col("task_id").alias("TaskID"),
        task_name("task_id").alias("Task"),
        F.col("dataset").alias("Dataset"),
        F.col("split").alias("Split"),
        F.col("pool").alias("CandPool"),
        *[F.col(f"`{m}`") for m in metrics],
    )


def _rank_in(table: dict, value: Column, default: int) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(value)), F.lit(default))


def order_columns() -> list[Column]:
    """Presentation order: task, fixed dataset and split order, union last."""
    return [
        F.col("TaskID"),
        _rank_in(K.RESULT_DATASET_ORDER, F.col("Dataset"), 99),
        _rank_in(K.RESULT_SPLIT_ORDER, F.col("Split"), 99),
        _rank_in(K.RESULT_POOL_ORDER, F.col("CandPool"), 0),
    ]


def ordered_results(results: DataFrame) -> DataFrame:
    return results.orderBy(*order_columns(), "Dataset", "Split", "CandPool")


def long_results(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per result and metric, union pool value beside the single pool.

    Metrics that were not computed are skipped.  With a union run the union
    value is its number or "N/A"; without one both union fields are "".
    """
    metrics = metrics or [m for m in K.RESULT_METRICS + K.ERROR_METRICS if m in results.columns]
    key = ["TaskID", "Task", "Dataset", "Split"]
    entries = F.array(
        *[F.struct(F.lit(i).alias("MetricOrder"), F.lit(m).alias("Metric"), F.col(f"`{m}`").cast("double").alias("Value")) for i, m in enumerate(metrics)]
    )
    rows = results.select(*key, "CandPool", F.inline(entries))
    # A result table has a handful of rows; one window avoids evaluating the
    # retrieval behind it a second time for a self-join.
    same = Window.partitionBy(*key, "Metric")
    is_union = F.col("CandPool") == "union"
    has = F.max(is_union).over(same)
    union = F.max(F.when(is_union, F.col("Value"))).over(same)
    placed = rows.withColumn("__has", has).withColumn("__union", union)
    return placed.where(~is_union & F.col("Value").isNotNull()).select(
        *key,
        "Metric",
        "MetricOrder",
        "CandPool",
        "Value",
        F.when(F.col("__has"), "union").otherwise("").alias("UnionPool"),
        F.when(F.col("__has"), F.coalesce(F.col("__union").cast("string"), F.lit("N/A"))).otherwise("").alias("UnionValue"),
    )


# -- error analysis ------------------------------------------------------------


def error_types(run: DataFrame, links: DataFrame, qrels: DataFrame, pool: DataFrame) -> DataFrame:
    """Type of the error at rank 1 per query, 0 for a correct answer.

    1: other modality than the task asks for; 2: other domain; 3: neither.
    ``links`` are the queries' positives, ``pool`` has did and modality.
    """
    top = run.where(F.col("rank") == 1).select("qid", "did")
    positives = links.where(F.col("label") == POS).select("qid", "did").distinct().withColumn("__ok", F.lit(True))
    judged = top.join(task_of_query(qrels), "qid").join(positives, ["qid", "did"], "left")
    typed = judged.join(pool.select("did", "modality"), "did")
    wrong_modality = F.get(task_modalities("task_id"), F.lit(1)) != F.col("modality")
    wrong_domain = dataset_domain(dataset_name("qid")) != dataset_domain(dataset_name("did"))
    kind = F.when(F.col("__ok"), 0).when(wrong_modality, 1).when(wrong_domain, 2).otherwise(3)
    return typed.select("qid", "did", "task_id", kind.alias("error_type"))


def error_rates(typed: DataFrame) -> DataFrame:
    """Share of each error type per task; the denominator is shared by all tasks."""
    counts = typed.groupBy("task_id").agg(
        *[F.sum((F.col("error_type") == t).cast("long")).alias(f"n_{t}") for t in (1, 2, 3)]
    )
    total = typed.agg(F.sum((F.col("error_type") > 0).cast("long"))).scalar()
    counted = counts.withColumn("false_positives", total)
    for t in (1, 2, 3):
        counted = counted.withColumn(f"Type{t}", rate(f"n_{t}", "false_positives"))
    return counted


def rerank_gain(before: DataFrame, after: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Hits before and after re-ranking, per task and depth."""
    both = before.withColumn("stage", F.lit("codes")).select("stage", "qid", "did", "rank").unionByName(
        after.withColumn("stage", F.lit("rerank")).select("stage", "qid", "did", "rank")
    )
    counts = hit_counts(both, qrels, ks, ["stage"])
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits")) for k in ks])
    rows = counts.select("task_id", "stage", "n", F.inline(entries))
    return rows.groupBy("task_id", "k").agg(
        F.max(F.when(F.col("stage") == "codes", F.col("hits"))).alias("hits_codes"),
        F.max(F.when(F.col("stage") == "rerank", F.col("hits"))).alias("hits_rerank"),
    )
