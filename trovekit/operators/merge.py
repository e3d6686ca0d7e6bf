"""Merging repeated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.operators.links import explode_links


def query_key():
    """Key of equal queries; a missing part reads ``None``, unlike an empty one."""
    parts = ["query_txt", "query_img_path", "query_modality"]
    return F.concat_ws("-", *[F.coalesce(F.col(p), F.lit("None")) for p in parts])


def merge_queries(queries: DataFrame, order: str = "pos") -> DataFrame:
    """One row per equal (text, image, modality).

    The first row gives id and source content; candidate lists are united in
    order of first appearance.  Candidates are deduplicated before any list is
    built, so a query repeated millions of times stays a small group.
    """
    keyed = queries.withColumn("key", query_key())
    first = keyed.groupBy("key").agg(
        F.min_by(
            F.struct("qid", "query_txt", "query_img_path", "query_modality", "query_src_content"), order
        ).alias("first")
    )
    links = merged_links(keyed, order)

    def listed(label: str):
        entry = F.when(F.col("label") == label, F.struct("at", "did"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["did"])

    lists = links.groupBy("key").agg(listed("pos").alias("pos_cand_list"), listed("neg").alias("neg_cand_list"))
    empty = F.array().cast("array<string>")
    return (
        first.join(lists, "key", "left")
        .select(
            "first.*",
            F.coalesce("pos_cand_list", empty).alias("pos_cand_list"),
            F.coalesce("neg_cand_list", empty).alias("neg_cand_list"),
        )
    )


def merged_links(keyed: DataFrame, order: str = "pos") -> DataFrame:
    """Distinct (key, label, did) with the place ``at`` of first appearance."""
    links = explode_links(keyed, ["key", order])
    return links.groupBy("key", "label", "did").agg(F.min(F.struct(order, "ord")).alias("at"))


def merge_soft_targets(rows: DataFrame, order: str = "pos") -> DataFrame:
    """One row per (reference, caption).

    The list fields follow the row order; maps are merged and a later value of
    a target wins.  Returns ``reference``, ``caption``, ``pairid_list``,
    ``target_hard_list``, ``img_set_list`` and ``target_soft``.
    """
    keys = ["reference", "caption"]
    fields = ["pairid", "target_hard", "img_set"]
    entry = F.struct(order, *fields)
    ordered = F.array_sort(F.collect_list(entry))
    lists = rows.groupBy(*keys).agg(ordered.alias("rows")).select(
        *keys, *[F.col(f"rows.{f}").alias(f"{f}_list") for f in fields]
    )
    latest = soft_target_scores(rows, order)
    maps = latest.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "score")))).alias("target_soft")
    )
    return lists.join(maps, keys, "left")


def soft_target_scores(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Long form of the merged maps: (reference, caption, target, score)."""
    exploded = rows.select("reference", "caption", order, F.explode("target_soft").alias("target", "score"))
    return exploded.groupBy("reference", "caption", "target").agg(F.max_by("score", order).alias("score"))
