"""Source rows to stored queries, pools and statistics: one plan per source shape.

Every plan returns (queries, pool): query records with their candidate lists,
numbered in source order, and the pool they refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovekit import constants as K
from trovekit.functions.ids import make_id
from trovekit.functions.text import clean_text
from trovekit.operators.convert import (
    answerable_questions,
    caption_pairs,
    composed_queries,
    entity_questions,
    extend_by_entity,
    fact_lists,
    graded_candidates,
    label_lists,
    matched_articles,
    number_queries,
    soft_targets,
    votes,
)
from trovekit.operators.links import POS, attach_lists
from trovekit.operators.merge import merge_queries, merge_soft_targets
from trovekit.operators.numbering import number_rows
from trovekit.operators.pools import chunked_kb_pool, fact_pool, kb_pool, pair_pool, renumber_pool, rewrite_links, text_image_pool
from trovekit.operators.sampling import cap_per_entity, trim_pool
from trovekit.session import materialize, release
from trovekit.sources.images import with_valid_image

RECORD = ["qid", "query_txt", "query_img_path", "query_modality", "query_src_content", "pos_cand_list", "neg_cand_list"]


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def query_records(rows: DataFrame, links: DataFrame, dataset: int, require_positive: bool = True) -> DataFrame:
    """Stored query records of ``rows`` (qid, pos and the query columns), numbered anew by ``pos``."""
    listed = attach_lists(rows, links, require_positive)
    return number_queries(listed.drop("qid"), dataset).select(*RECORD)


def caption_collection(raw: DataFrame, manifest: DataFrame, dataset: int) -> tuple[DataFrame, DataFrame]:
    """Caption and image rows -> (queries, pool).

    Queries with equal content are merged and numbered in order of appearance.
    ``raw`` may bring the ``src_content`` that the query records carry.
    """
    good = with_valid_image(raw, manifest)
    pool = text_image_pool(good, dataset)
    pairs = caption_pairs(good, pool).withColumn("at", F.col("pos") * 2 + F.col("part"))
    if "src_content" in raw.columns:
        pairs = pairs.join(good.select("pos", "src_content"), "pos")
    else:
        pairs = pairs.withColumn("src_content", _text())
    records = pairs.select(
        F.col("at").alias("pos"),
        make_id(dataset, "at").alias("qid"),
        "query_txt",
        "query_img_path",
        "query_modality",
        F.col("src_content").alias("query_src_content"),
        F.array("did").alias("pos_cand_list"),
        F.array().cast("array<string>").alias("neg_cand_list"),
    )
    merged = merge_queries(records).withColumn("pos", F.split_part("qid", F.lit(":"), F.lit(2)).cast("long"))
    return number_queries(merged.drop("qid"), dataset), pool


def graded_collection(entries: DataFrame, graded: DataFrame, manifest: DataFrame, dataset: int) -> tuple[DataFrame, DataFrame]:
    """Queries with scored (image, text) candidates -> (queries, pool).

    ``entries``: ``pos``, ``id``, ``query``; ``graded``: ``id``, ``ord``,
    ``candidate_id``, ``caption``, ``img_path``, ``score``.  The source content
    lists the scores of the candidates under their source ids.
    """
    parts = graded.join(entries.select("id", "pos"), "id")
    raw = parts.select(F.struct("pos", "ord").alias("pos"), "caption", "img_path", _json(id=F.col("candidate_id").cast("string")).alias("src_content"))
    pool = pair_pool([raw], dataset, manifest)
    cands = with_valid_image(
        parts.select("id", "ord", "candidate_id", "score", clean_text("caption").alias("txt"), "img_path", _text(K.IMAGE_TEXT).alias("modality")), manifest
    ).where(F.col("txt") != "")
    links = graded_candidates(cands.withColumn("qid", F.col("id").cast("string")), pool)
    entry = F.struct(F.col("candidate_id").cast("string").alias("candidate_id"), F.col("score").cast("string").alias("score"))

    def listed(positive: bool) -> Column:
        mine = F.when((F.col("score") == 3) == F.lit(positive), F.struct("ord", entry.alias("e")))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["e"])

    scores = cands.groupBy("id").agg(listed(True).alias("p"), listed(False).alias("n"))
    rows = entries.withColumn("query_txt", clean_text("query")).where(F.col("query_txt") != "").join(scores, "id")
    rows = rows.select(
        "pos",
        F.col("id").cast("string").alias("qid"),
        "query_txt",
        _text().alias("query_img_path"),
        _text(K.TEXT).alias("query_modality"),
        _json(id=F.col("id").cast("string"), pos_cand_candidate_id_scores=F.col("p"), neg_cand_candidate_id_scores=F.col("n")).alias("query_src_content"),
    )
    return query_records(rows, links, dataset), pool


def fact_collection(questions: DataFrame, parts: list[DataFrame], dataset: int, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions with four fact lists -> (queries, pool).

    ``questions``: ``pos``, ``guid``, ``category``, ``question`` and the fact list
    columns; ``parts`` as ``fact_pool`` takes them.
    """
    pool = fact_pool(parts, dataset, manifest)
    keyed = questions.withColumn("qid", F.col("guid").cast("string"))
    links = fact_lists(keyed, pool)
    rows = keyed.withColumn("query_txt", clean_text("question")).where(F.col("query_txt") != "").select(
        "pos",
        "qid",
        "query_txt",
        _text().alias("query_img_path"),
        _text(K.TEXT).alias("query_modality"),
        _json(Guid=F.col("guid").cast("string"), Qcate=F.coalesce(F.col("category").cast("string"), F.lit(""))).alias("query_src_content"),
    )
    return query_records(rows, links, dataset, require_positive=False), pool


def vote_collection(triplets: DataFrame, images: DataFrame, dataset: int) -> DataFrame:
    """Votes between two images for a reference -> image queries with one positive and one negative.

    ``triplets``: ``pos``, ``id``, ``ref_path`` and the columns of ``votes``.
    """
    judged = votes(triplets.withColumn("qid", F.col("id").cast("string")), images)
    rows = triplets.select("pos", F.col("id").cast("string").alias("qid"), "ref_path").join(judged, "qid")
    records = rows.select(
        "pos",
        _text().alias("query_txt"),
        F.col("ref_path").alias("query_img_path"),
        _text(K.IMAGE).alias("query_modality"),
        _json(id=F.col("qid")).alias("query_src_content"),
        F.array("pos_did").alias("pos_cand_list"),
        F.array("neg_did").alias("neg_cand_list"),
    )
    return number_queries(records, dataset).select(*RECORD)


def soft_collection(rows: DataFrame, images: DataFrame, dataset: int) -> DataFrame:
    """Reference, caption and scored targets -> merged queries with all scored images.

    ``rows`` as ``merge_soft_targets`` takes them; ``images``: ``image_id``,
    ``img_path``, ``did``.  Queries whose reference has no image go.
    """
    merged = merge_soft_targets(rows)
    first = rows.groupBy("reference", "caption").agg(F.min("pos").alias("pos"))
    keyed = merged.join(first, ["reference", "caption"]).withColumn("qid", F.col("pos").cast("string"))
    links = soft_targets(keyed.select("qid", "target_soft"), images.select("image_id", "did"))
    refs = images.select(F.col("image_id").alias("reference"), F.col("img_path").alias("query_img_path"))
    records = keyed.join(refs, "reference").withColumn("query_txt", clean_text("caption")).where(F.col("query_txt") != "")
    records = records.select(
        "pos",
        "qid",
        "query_txt",
        "query_img_path",
        _text(K.IMAGE_TEXT).alias("query_modality"),
        _json(id=F.col("reference").cast("string")).alias("query_src_content"),
    )
    return query_records(records, links, dataset)


def composed_collection(rows: DataFrame, images: DataFrame, dataset: int, concatenate: bool = True) -> DataFrame:
    """Reference image plus captions -> queries with their target image, equal queries merged."""
    found = composed_queries(rows, images, concatenate)
    source = rows.select("pos", _json(id=F.col("candidate").cast("string")).alias("query_src_content"))
    records = found.join(source, "pos").select(
        F.struct("pos", "part").alias("pos"),
        F.concat_ws("/", F.col("pos").cast("string"), F.col("part").cast("string")).alias("qid"),
        "query_txt",
        "query_img_path",
        "query_modality",
        "query_src_content",
        F.array("did").alias("pos_cand_list"),
        F.array().cast("array<string>").alias("neg_cand_list"),
    )
    merged = merge_queries(records)
    order = F.struct(*[F.split_part("qid", F.lit("/"), F.lit(i)).cast("long").alias(f"p{i}") for i in (1, 2)])
    return number_queries(merged.withColumn("pos", order).drop("qid"), dataset).select(*RECORD)


def entity_collection(
    questions: DataFrame,
    articles: DataFrame,
    manifest: DataFrame,
    chunks: DataFrame,
    dataset: int,
    text_limit: int,
    image_text_limit: int,
    others: int,
) -> tuple[DataFrame, DataFrame]:
    """Entity-linked questions -> (queries, pool): cap per entity, convert, trim, renumber, extend.

    ``questions`` as ``entity_questions`` takes them, with ``file``; ``articles`` as
    ``kb_pool`` takes them; ``chunks`` (``entity_id``, ``ord``, ``did``) is a second
    pool whose candidates of the same entity become positives too.
    """
    # each of these is read several times
    entities = materialize(kb_pool(articles, manifest, dataset), "entities")
    linked = materialize(questions.join(entities.select("entity_id", "modality"), "entity_id"), "linked")
    capped = cap_per_entity(linked, "entity_id", "data_id", text_limit, image_text_limit).drop("modality")
    found = materialize(entity_questions(capped, entities), "found")
    release(linked)
    links = found.select(F.col("data_id").cast("string").alias("qid"), F.lit(POS).alias("label"), F.lit(0).alias("ord"), "did")
    trimmed = trim_pool(entities, links, others)
    pool = materialize(renumber_pool(trimmed, dataset, ["rank"]), "renumbered")
    moved = extend_by_entity(rewrite_links(links, pool), pool, chunks)
    rows = found.select(
        "pos",
        F.col("data_id").cast("string").alias("qid"),
        "query_txt",
        F.col("img_path").alias("query_img_path"),
        _text(K.IMAGE_TEXT).alias("query_modality"),
        _json(data_id=F.col("data_id").cast("string"), entity_id=F.col("entity_id").cast("string")).alias("query_src_content"),
    )
    return query_records(rows, moved, dataset), pool.drop("rank")


def write_capped(capped: DataFrame, path: str) -> None:
    """Capped rows back in folders by the file they came from."""
    capped.write.mode("overwrite").partitionBy("file").json(path)


def kb_collection(
    questions: DataFrame, entity_of: DataFrame, articles: DataFrame, manifest: DataFrame, dataset: int
) -> tuple[DataFrame, DataFrame]:
    """Answerable questions -> (queries, chunked pool of the matched articles)."""
    kept = answerable_questions(questions, entity_of, articles)
    pool = chunked_kb_pool(matched_articles(kept, articles), manifest, dataset)
    chunks = pool.select("entity_id", F.col("chunk").alias("ord"), "txt", "did")
    keyed = kept.withColumn("qid", F.col("data_id").cast("string"))
    lists = label_lists(keyed.select("qid", "entity_id", "answer", "answer_eval"), chunks)
    content = _json(data_id=F.col("data_id").cast("string"), answer=F.col("answer"), answer_eval=F.col("answer_eval"), entity_id=F.col("entity_id").cast("string"))
    queries = keyed.drop("pos_cand_list", "neg_cand_list").withColumn("query_src_content", content).join(lists, "qid")
    numbered = number_rows(queries.drop("qid"), "pos", "__n")
    return numbered.withColumn("qid", make_id(dataset, "__n")).drop("__n"), pool
