"""Relevance judgements and run files in the whitespace-separated text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovekit.sources.records import file_position


def _fields(spark: SparkSession, path, source: Column | None = None):
    more = [] if source is None else [source.alias("source")]
    lines = spark.read.text(path).select(F.trim("value").alias("line"), file_position().alias("pos"), *more)
    return lines.where(F.col("line") != "").select(F.split("line", r"\s+").alias("f"), "pos", *(["source"] if more else []))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """Judgements from a split-line column ``f``; only relevance > 0 counts."""
    rows = lines.select(
        *[c for c in lines.columns if c == "source"],
        F.col("f")[0].alias("qid"),
        F.col("f")[2].alias("did"),
        F.col("f")[3].cast("int").alias("relevance"),
        F.col("f")[4].cast("int").alias("task_id"),
        "pos",
    )
    return rows.where(F.col("relevance") > 0)


def read_qrels(spark: SparkSession, path, source: Column | None = None) -> DataFrame:
    """Judgements of one or several paths; ``source`` is added as a column."""
    return parse_qrels(_fields(spark, path, source))


def qrel_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", "qid", F.lit("0"), "did", "relevance", "task_id").alias("value"))


def task_of_query(qrels: DataFrame, order="pos") -> DataFrame:
    """First task id seen per query."""
    return qrels.groupBy("qid").agg(F.min_by("task_id", order).alias("task_id"))


def read_run(spark: SparkSession, path, with_task: bool = True, source: Column | None = None) -> DataFrame:
    """Run rows; files have six fields, or seven with the task id; ``source`` is added as a column."""
    f = F.col("f")
    columns = [
        *([] if source is None else ["source"]),
        f[0].alias("qid"),
        f[2].alias("did"),
        f[3].cast("int").alias("rank"),
        f[4].cast("double").alias("score"),
        f[5].alias("run_id"),
    ]
    if with_task:
        columns.append(F.get(f, 6).cast("int").alias("task_id"))
    return _fields(spark, path, source).select(*columns)


def run_name(dataset: str, pool: str, split: str, k: int) -> str:
    kind = "union_pool" if pool == "union" else "single_pool"
    return f"{dataset}_{kind}_{split}_k{k}"


def run_lines(run: DataFrame) -> DataFrame:
    """Lines ``qid Q0 did rank score run_id [task_id]`` beside qid, rank and run_id."""
    tail = ["task_id"] if "task_id" in run.columns else []
    line = F.concat_ws(
        " ", "qid", F.lit("Q0"), "did", F.col("rank").cast("string"), F.col("score").cast("string"), "run_id", *tail
    )
    return run.select("qid", "rank", "run_id", line.alias("value"))


def write_run(run: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write a run, range-partitioned and sorted by query and rank.

    The part files in name order are one globally sorted run file.
    """
    lines = run_lines(run)
    ranged = (
        lines.repartitionByRange(partitions, "qid") if partitions else lines.repartitionByRange("qid")
    )
    ranged.sortWithinPartitions("qid", "rank").select("value").write.mode("overwrite").text(path)


def write_runs(run: DataFrame, folder: str, names: list[str]) -> dict[str, str]:
    """Write the runs of all ``names`` (column ``run_id``) in one job, each as ``<folder>/<name>_run.txt``.

    Returns the paths.  A run without rows is an empty folder.
    """
    spark = run.sparkSession
    staged = f"{folder}/.staged"
    ranged = run_lines(run).repartitionByRange("run_id", "qid").sortWithinPartitions("run_id", "qid", "rank")
    ranged.select(F.col("run_id").alias("run"), "value").write.partitionBy("run").mode("overwrite").text(staged)
    paths = {n: f"{folder}/{n}_run.txt" for n in names}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, path in paths.items():  # folders get their names, nothing is copied
        files.delete(hadoop(path), True)
        if not files.rename(hadoop(f"{staged}/run={name}"), hadoop(path)):
            files.mkdirs(hadoop(path))
    files.delete(hadoop(staged), True)
    return paths
