"""Queries with their candidates, in long form.

A *link* is one row (qid, label, ord, did): label ``pos`` or ``neg`` and the
place in the list.  Joins, filters and counts work on links; arrays are built
only for the stored query records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POS = "pos"
NEG = "neg"


def explode_links(queries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Links of stored query records; ``keep`` repeats further columns."""
    keep = keep or []

    def side(label: str, column: str) -> DataFrame:
        return queries.select("qid", *keep, F.lit(label).alias("label"), F.posexplode(column).alias("ord", "did"))

    return side(POS, "pos_cand_list").unionByName(side(NEG, "neg_cand_list"))


def collect_links(links: DataFrame) -> DataFrame:
    """(qid, pos_cand_list, neg_cand_list) with the list order kept."""

    def listed(label: str):
        entry = F.when(F.col("label") == label, F.struct("ord", "did"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["did"])

    return links.groupBy("qid").agg(listed(POS).alias("pos_cand_list"), listed(NEG).alias("neg_cand_list"))


def attach_lists(queries: DataFrame, links: DataFrame, require_positive: bool = False) -> DataFrame:
    """Queries with both lists; queries without links get empty lists."""
    base = queries.drop("pos_cand_list", "neg_cand_list")
    empty = F.array().cast("array<string>")
    joined = base.join(collect_links(links), "qid", "left")
    for c in ("pos_cand_list", "neg_cand_list"):
        joined = joined.withColumn(c, F.coalesce(c, empty))
    return joined.where(F.size("pos_cand_list") > 0) if require_positive else joined


def queries_with_positive(links: DataFrame) -> DataFrame:
    """Distinct queries that have at least one positive."""
    return links.where(F.col("label") == POS).select("qid").distinct()


def keep_with_positive(links: DataFrame) -> DataFrame:
    """Links of queries that have a positive.

    One pass over the links, partitioned by query as the lists built from them
    are; a query's links are as many as its own candidates.
    """
    has = F.max((F.col("label") == POS).cast("int")).over(Window.partitionBy("qid"))
    return links.withColumn("__has", has).where(F.col("__has") == 1).drop("__has")


def first_positive(links: DataFrame) -> DataFrame:
    return links.where(F.col("label") == POS).groupBy("qid").agg(F.min_by("did", "ord").alias("did"))
