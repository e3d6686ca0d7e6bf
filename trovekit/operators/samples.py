"""Records handed to a trainer or an encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.functions.ids import hash_did, hash_qid, id_dataset, task_id
from trovekit.functions.text import clean_text
from trovekit.operators.links import explode_links
from trovekit.operators.sampling import pick_n_positives, pick_negatives, pick_positive, pick_prompt


def query_records(queries: DataFrame, with_source: bool = False) -> DataFrame:
    columns = [
        hash_qid("qid").alias("qid"),
        clean_text("query_txt").alias("txt"),
        F.col("query_img_path").alias("img_path"),
        F.col("query_modality").alias("modality"),
    ]
    if with_source:
        columns.append(F.col("query_src_content").alias("src_content"))
    return queries.select(*columns)


def candidate_records(pool: DataFrame, with_source: bool = False) -> DataFrame:
    columns = [hash_did("did").alias("did"), clean_text("txt").alias("txt"), "img_path", "modality"]
    if with_source:
        columns.append("src_content")
    return pool.select(*columns)


def same_dataset_positives(queries: DataFrame) -> DataFrame:
    """Keep only positives of the query's own dataset (evaluation mode)."""
    ds = id_dataset("qid")
    return queries.withColumn("pos_cand_list", F.filter("pos_cand_list", lambda d: id_dataset(d) == ds))


def training_samples(
    queries: DataFrame,
    pool: DataFrame,
    prompts: DataFrame,
    negatives: int = 0,
    seed: int = 2023,
    random_positive: bool = True,
    evaluate: bool = False,
) -> DataFrame:
    """Query + chosen positive + instruction, one row per query.

    ``neg_dids`` holds the chosen negatives in order; ``sample_negatives``
    hydrates them.  In evaluation mode only positives of the same dataset count.
    A query without a positive, without a negative where some are asked for, or
    whose positive is not in the pool fails the job; filter such queries first
    if they are expected.
    """
    rows = same_dataset_positives(queries) if evaluate else queries
    if negatives and not evaluate:
        rows = rows.withColumn("neg_dids", _required("neg_cand_list", "negative", pick_negatives(negatives, seed=seed)))
    else:
        rows = rows.withColumn("neg_dids", F.array().cast("array<string>"))
    chosen = _required("pos_cand_list", "positive", pick_positive(seed=seed, random=random_positive))
    rows = rows.withColumn("did", chosen).drop("pos_cand_list", "neg_cand_list")
    cand = pool.select(
        "did",
        clean_text("txt").alias("pos_txt"),
        F.col("img_path").alias("pos_img_path"),
        F.col("modality").alias("cand_modality"),
        F.lit(True).alias("__found"),
    )
    joined = rows.join(cand, "did", "left")
    absent = F.raise_error(F.concat(F.lit("positive that is not in the pool: "), F.coalesce("did", F.lit("NULL"))))
    joined = joined.withColumn("cand_modality", F.when(F.col("__found"), F.col("cand_modality")).otherwise(absent))
    joined = joined.drop("__found").withColumn("dataset_id", id_dataset("qid"))
    prompted = pick_prompt(joined, prompts, "qid", seed)
    return prompted.select(
        "qid",
        hash_qid("qid").alias("hashed_qid"),
        hash_did("did").alias("hashed_did"),
        task_id("query_modality", "cand_modality").alias("task_id"),
        "prompt",
        clean_text(F.concat_ws(" ", "prompt", F.coalesce("query_txt", F.lit("")))).alias("query_txt_with_prompt"),
        clean_text("query_txt").alias("query_txt"),
        "query_img_path",
        "pos_txt",
        "pos_img_path",
        "neg_dids",
    )


def _required(column: str, kind: str, value):
    """``value`` where the list has entries; an empty or NULL list fails the job."""
    none = F.raise_error(F.concat(F.lit(f"query without {kind}: "), F.coalesce("qid", F.lit("NULL"))))
    return F.when(F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0, value).otherwise(none)


def sample_negatives(samples: DataFrame, pool: DataFrame) -> DataFrame:
    """Chosen negatives with their text and image, one row per place."""
    places = samples.select("qid", F.posexplode("neg_dids").alias("place", "did"))
    cand = pool.select("did", clean_text("txt").alias("txt"), "img_path")
    return places.join(cand, "did").select("qid", "place", "did", "txt", "img_path")


def positive_pairs(queries: DataFrame, n: int, seed: int = 2023, shuffle: bool = True) -> DataFrame:
    """(qid, slot, did, place): ``n`` positives per query, order kept."""
    rows = queries.where(F.size("pos_cand_list") > 0)
    return rows.select(
        "qid", F.posexplode(pick_n_positives(n, seed=seed, shuffle=shuffle)).alias("slot", "p")
    ).select("qid", "slot", "p.did", "p.place")


def pair_features(pairs: DataFrame, query_features: DataFrame, pool_features: DataFrame) -> DataFrame:
    """Query and positive features joined by hashed id."""
    q = query_features.select(*[F.col(c).alias(f"q_{c}") for c in query_features.columns])
    p = pool_features.select(*[F.col(c).alias(f"p_{c}") for c in pool_features.columns])
    keyed = pairs.withColumn("q_id", hash_qid("qid")).withColumn("p_id", hash_did("did"))
    return keyed.join(q, "q_id").join(p, "p_id")


def referenced_records(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Every (query, candidate) link with the candidate's record."""
    return explode_links(queries).join(pool, "did")
