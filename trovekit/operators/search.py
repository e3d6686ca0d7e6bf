"""Embedding retrieval: encoding, index tables, exact search, mining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovekit.functions.ids import make_id, task_id
from trovekit.functions.vectors import normalize
from trovekit.operators.blocks import blocked_top_k
from trovekit.operators.links import NEG
from trovekit.operators.numbering import number_by_position
from trovekit.operators.pools import first_seen, union_pools


def encode(records: DataFrame, encoder: Callable, schema: str) -> DataFrame:
    """Run a batch encoder over records; ids must be unique, the first row wins.

    ``encoder`` is ``Iterator[pandas.DataFrame] -> Iterator[pandas.DataFrame]``.
    """
    return records.mapInPandas(encoder, schema)


def encode_unique(records: DataFrame, encoder: Callable, schema: str, key: str, order: str) -> DataFrame:
    """``encode`` after keeping the first record per id."""
    return encode(first_seen(records, key, order), encoder, schema)


def build_index(vectors: DataFrame, dim: int, key: str = "did", vector: str = "embedding") -> DataFrame:
    """Unit vectors with a checked dimension; a wrong length fails the job."""
    wrong = F.raise_error(
        F.concat_ws(" ", F.lit("vector of length"), F.size(vector).cast("string"), F.lit(f"where {dim} is expected"))
    )
    checked = F.when(F.size(vector) == dim, normalize(vector)).otherwise(wrong.cast("array<double>"))
    return vectors.select(F.col(key), checked.alias(vector))


def union_index(indexes: list[DataFrame]) -> DataFrame:
    """Union pool from stored vectors, nothing is encoded again."""
    return union_pools(indexes)


def top_k(queries: DataFrame, pool: DataFrame, k: int, **options) -> DataFrame:
    """Exact search by cosine: (qid, did, score, rank)."""
    return blocked_top_k(queries, pool, k, **options)


def hydrate(run: DataFrame, pool: DataFrame) -> DataFrame:
    """Full candidate rows of a run, rank kept."""
    return run.join(pool, "did")


def hydrate_lists(run: DataFrame, pool: DataFrame) -> DataFrame:
    """Per query the retrieved candidates in rank order (k entries)."""
    row = F.struct("rank", "score", "did", *[c for c in pool.columns if c != "did"])
    return hydrate(run, pool).groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("candidates"))


def retrieved_pairs(run: DataFrame, pool: DataFrame, modality: str = "image,text") -> DataFrame:
    """Retrieved candidates of one modality for downstream use."""
    return hydrate(run, pool.where(F.col("modality") == modality))


def hard_negatives(run: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """New negative links: retrieved candidates that are not yet linked.

    Fewer than ``n`` are repeated in order up to ``n``; none adds nothing.
    Result: (qid, label, ord, did) with ``ord`` 0..n-1 to append.
    """
    fresh = run.select("qid", "did", "rank").join(links.select("qid", "did").distinct(), ["qid", "did"], "left_anti")
    per_query = Window.partitionBy("qid").orderBy("rank")
    placed = fresh.withColumn("at", F.row_number().over(per_query) - 1).where(F.col("at") < n)
    # at most n rows per query are left here
    counted = placed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("qid")).cast("int"))
    repeated = counted.select("qid", F.explode(F.sequence(F.col("at"), F.lit(n - 1), F.col("m"))).alias("ord"), "did")
    return repeated.select("qid", F.lit(NEG).alias("label"), "ord", "did")


def append_negatives(links: DataFrame, mined: DataFrame) -> DataFrame:
    """All links, mined negatives after the known ones."""
    old = links.withColumn("ord", F.struct(F.lit(0).alias("src"), F.col("ord").cast("long").alias("at")))
    new = mined.withColumn("ord", F.struct(F.lit(1).alias("src"), F.col("ord").cast("long").alias("at")))
    return old.unionByName(new)


# -- interactive queries -------------------------------------------------------


def check_queries(queries: DataFrame) -> DataFrame:
    """Add ``problem``: NULL, or what is wrong with the declared modality."""
    m, t, i = F.col("query_modality"), F.coalesce("query_txt", F.lit("")) != "", F.coalesce("query_img_path", F.lit("")) != ""
    no_text, no_image = F.col("query_txt").isNull(), F.col("query_img_path").isNull()
    problem = (
        F.when(m.isNull() | ~m.isin("text", "image", "image,text"), "unknown modality")
        .when((m == "text") & ~t, "text query without text")
        .when((m == "text") & ~no_image, "text query with image")
        .when((m == "image") & ~no_text, "image query with text")
        .when((m == "image") & ~i, "image query without image")
        .when((m == "image,text") & ~t, "image and text query without text")
        .when((m == "image,text") & ~i, "image and text query without image")
    )
    return queries.withColumn("problem", problem)


def prepare_queries(queries: DataFrame, dataset: int, position: str = "pos") -> DataFrame:
    """Valid queries numbered ``"<dataset>:<i>"`` in order, with their task id."""
    good = check_queries(queries).where(F.col("problem").isNull()).drop("problem")
    numbered = number_by_position(good, position, "__n")
    return numbered.withColumn("qid", make_id(dataset, "__n")).drop("__n").withColumn(
        "task_id", task_id("query_modality", "candidate_modality")
    )
