"""Source rows -> queries and links, one function per source shape.

Every converter returns links (query key ``qid``, label, ord, did) or query
rows with their positive; ids of queries are assigned afterwards in the order
of ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovekit import constants as K
from trovekit.functions.text import clean_text, doc_key, folder_key, merge_captions
from trovekit.operators.links import NEG, POS, keep_with_positive
from trovekit.operators.numbering import BUCKET_ROWS, assign_ids
from trovekit.operators.pools import first_seen
from trovekit.operators.skew import lookup_join, skew_join
from trovekit.operators.substrings import answer_hits, answer_parts, places_of, whole_slices
from trovekit.session import materialize
from trovekit.sources.images import with_valid_image


KEY = ["__key", "__key2"]


def content_key(key: Column) -> list[Column]:
    """128-bit name of a content key: joins move it instead of whole captions."""
    return [F.xxhash64(key).alias(KEY[0]), F.xxhash64(F.lit("second"), key).alias(KEY[1])]


def pool_keys(pool: DataFrame) -> DataFrame:
    """(key, did) of a pool."""
    return pool.select(*content_key(doc_key()), "did")


def _known(did: str, what: str) -> Column:
    """The id found for a reference; one that the pool lacks fails the job."""
    return F.coalesce(F.col(did), F.raise_error(F.concat(F.lit("not in the pool: "), F.coalesce(F.col(what).cast("string"), F.lit("NULL")))))


def caption_pairs(raw: DataFrame, pool: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Paired caption and image -> an image and a text query each.

    ``raw`` has ``pos``, ``caption``, ``img_path``.  Rows without text or with
    an unreadable image give no query.  Result: one row per query with its
    positive ``did``, ordered by (pos, part).
    """
    rows = raw.select("pos", clean_text("caption").alias("caption"), "img_path").where(F.col("caption") != "")
    if manifest is not None:
        rows = with_valid_image(rows, manifest)
    none = F.lit(None).cast("string")
    image_query = F.struct(
        F.lit(0).alias("part"),
        none.alias("query_txt"),
        F.col("img_path").alias("query_img_path"),
        F.lit(K.IMAGE).alias("query_modality"),
        doc_key("caption", none, F.lit(K.TEXT)).alias("doc_key"),
    )
    text_query = F.struct(
        F.lit(1).alias("part"),
        F.col("caption").alias("query_txt"),
        none.alias("query_img_path"),
        F.lit(K.TEXT).alias("query_modality"),
        doc_key(none, "img_path", F.lit(K.IMAGE)).alias("doc_key"),
    )
    queries = rows.select("pos", F.inline(F.array(image_query, text_query)))
    queries = queries.select("*", *content_key(F.col("doc_key"))).drop("doc_key")
    return lookup_join(queries, pool_keys(pool), KEY).drop(*KEY)


def graded_candidates(
    graded: DataFrame, pool: DataFrame, positive_score: int = 3, manifest: DataFrame | None = None
) -> DataFrame:
    """Scored candidates -> positives (best score) and negatives (the rest).

    ``graded`` has one row per candidate: ``qid``, ``ord``, ``txt``,
    ``img_path``, ``modality``, ``score``.  Candidates without text or, given a
    manifest, with an unreadable image are left out, as they are from the pool;
    any other candidate that the pool lacks fails the job.  Queries without
    positive go.
    """
    graded = graded.where(F.col("txt") != "")
    if manifest is not None:
        graded = with_valid_image(graded, manifest)
    keyed = graded.select("qid", "ord", "score", *content_key(doc_key()))
    found = lookup_join(keyed, pool_keys(pool), KEY, "left")
    label = F.when(F.col("score") == positive_score, F.lit(POS)).otherwise(F.lit(NEG))
    return keep_with_positive(found.select("qid", label.alias("label"), "ord", _known("did", "qid").alias("did")))


FACT_LISTS = [  # (column, label, modality) in list order
    ("img_posFacts", POS, K.IMAGE_TEXT),
    ("img_negFacts", NEG, K.IMAGE_TEXT),
    ("txt_posFacts", POS, K.TEXT),
    ("txt_negFacts", NEG, K.TEXT),
]


def fact_lists(facts: DataFrame, pool: DataFrame) -> DataFrame:
    """Four fact lists per question -> links; unknown candidates are skipped.

    ``facts`` has ``qid`` and the four columns of ``FACT_LISTS``, arrays of
    struct(txt, img_path).  Image facts precede text facts in both lists.
    """
    parts = [
        facts.select(
            "qid",
            F.lit(label).alias("label"),
            F.lit(rank).alias("part"),
            F.posexplode(column).alias("place", "fact"),
            F.lit(modality).alias("modality"),
        )
        for rank, (column, label, modality) in enumerate(FACT_LISTS)
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    keyed = rows.select(
        "qid",
        "label",
        (F.col("part").cast("long") * 1_000_000_000 + F.col("place")).alias("ord"),
        *content_key(
            doc_key(clean_text("fact.txt"), F.when(F.col("modality") == K.IMAGE_TEXT, F.col("fact.img_path")), "modality")
        ),
    )
    return lookup_join(keyed, pool_keys(pool), KEY).drop(*KEY)


def soft_targets(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Map target -> score; score 1.0 is positive, anything else negative.

    ``queries`` has ``qid`` and ``target_soft``; ``images`` has ``image_id``
    and ``did``.  Queries without positive go.
    """
    targets = queries.select("qid", F.posexplode("target_soft").alias("ord", "image_id", "score"))
    found = lookup_join(targets, images, "image_id")
    label = F.when(F.col("score") == 1.0, F.lit(POS)).otherwise(F.lit(NEG))
    return keep_with_positive(found.select("qid", label.alias("label"), "ord", "did"))


def votes(triplets: DataFrame, images: DataFrame) -> DataFrame:
    """Two-alternative vote -> one positive and one negative image.

    ``triplets`` has ``qid``, ``left_path``, ``right_path``, ``right_vote``
    ("0" or "1"); ``images`` has ``image_id`` (folder/name) and ``did``.  A row
    with a missing image is dropped.
    """
    left, right = folder_key("left_path"), folder_key("right_path")
    bad = F.raise_error(F.concat(F.lit("invalid vote: "), F.coalesce("right_vote", F.lit("NULL"))))
    vote = F.col("right_vote")
    keyed = triplets.select(
        "qid",
        F.when(vote == "0", left).when(vote == "1", right).otherwise(bad).alias("pos_key"),
        F.when(vote == "0", right).when(vote == "1", left).otherwise(bad).alias("neg_key"),
    )
    pos = images.select(F.col("image_id").alias("pos_key"), F.col("did").alias("pos_did"))
    neg = images.select(F.col("image_id").alias("neg_key"), F.col("did").alias("neg_did"))
    found = lookup_join(lookup_join(keyed, pos, "pos_key"), neg, "neg_key")
    return found.select("qid", "pos_did", "neg_did")


def composed_queries(rows: DataFrame, images: DataFrame, concatenate: bool = True) -> DataFrame:
    """Reference image plus captions -> target image.

    ``rows`` has ``pos``, ``candidate``, ``target``, ``captions`` (array);
    ``images`` has ``image_id``, ``img_path``, ``did``.  With ``concatenate``
    the captions become one query text, otherwise one query each.
    """
    if concatenate:
        texts = F.array(merge_captions("captions"))
    else:
        texts = F.transform("captions", lambda c: clean_text(c))
    queries = rows.select("pos", "candidate", "target", F.posexplode(texts).alias("part", "query_txt"))
    queries = queries.where(F.col("query_txt") != "")
    reference = images.select(F.col("image_id").alias("candidate"), F.col("img_path").alias("query_img_path"))
    target = images.select(F.col("image_id").alias("target"), "did")
    with_reference = lookup_join(queries, reference, "candidate")
    return lookup_join(with_reference, target, "target").select(
        "pos", "part", "query_txt", "query_img_path", F.lit(K.IMAGE_TEXT).alias("query_modality"), "did"
    )


def entity_questions(questions: DataFrame, entities: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Question linked to an entity -> the entity's candidate.

    ``questions`` has ``pos``, ``data_id``, ``question``, ``img_path``,
    ``entity_id``; ``entities`` has ``entity_id`` and ``did``.  Repeated
    ``data_id`` keeps the first row; empty questions go.
    """
    rows = first_seen(questions, "data_id", "pos")
    rows = rows.withColumn("query_txt", clean_text("question")).where(F.col("query_txt") != "")
    if manifest is not None:
        rows = with_valid_image(rows, manifest)
    return lookup_join(rows, entities.select("entity_id", "did"), "entity_id")


def answerable_questions(
    questions: DataFrame,
    entity_of: DataFrame,
    articles: DataFrame,
    question_types: DataFrame | None = None,
) -> DataFrame:
    """Questions whose linked article contains an answer.

    ``questions``: ``pos``, ``data_id``, ``question``, ``answer``,
    ``answer_eval`` (arrays of strings); ``entity_of``: data_id -> entity_id;
    ``articles``: ``entity_id``, ``content``; ``question_types``: data_id ->
    question_type.  Keeps the first row per ``data_id``.

    The different answers of an entity are searched for once; contents meet lists of
    answers by a shuffle, whatever size Spark expects them to have, and no question.
    """
    # dealt by data_id, where the other two are met as well
    rows = first_seen(questions, "data_id", "pos", stored=False).where(clean_text("question") != "")
    linked = rows.join(entity_of, "data_id")
    if question_types is not None:
        linked = linked.join(question_types, "data_id", "left")
    linked = materialize(linked, "linked")
    options = F.concat("answer", "answer_eval")
    lists = answer_parts(linked.select("entity_id", F.explode(options).alias("answer")), "entity_id")
    # computed contents are larger than their files, so they are never broadcast
    met = lists.join(articles.select("entity_id", "content").hint("merge"), "entity_id")
    held = F.filter("answers", lambda a: F.contains("content", a)).alias("held")
    met = materialize(met.select("entity_id", "parts", held).where(F.size("held") > 0), "answers-held")
    few = linked.join(met.where("parts = 1").drop("parts").hint("merge"), "entity_id").where(F.arrays_overlap(options, "held")).drop("held")
    # an entity of very many answers: question and answer meet as rows
    many = met.where("parts > 1").select("entity_id", F.explode("held").alias("answer"))
    asked = linked.join(many.select("entity_id").distinct(), "entity_id", "left_semi")
    pairs = asked.select("data_id", "entity_id", F.explode(options).alias("answer"))
    answered = pairs.join(many.hint("merge"), ["entity_id", "answer"], "left_semi").select("data_id", "entity_id").distinct()
    return few.unionByName(asked.join(answered, ["data_id", "entity_id"], "left_semi").select(few.columns))


def matched_articles(kept: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct articles that some kept question refers to (the raw pool)."""
    return articles.join(kept.select("entity_id").distinct(), "entity_id", "left_semi")


def label_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of the linked entity as positive or negative.

    A chunk that contains an answer is positive.  ``questions`` has ``qid`` (one row
    each), ``entity_id``, ``answer``, ``answer_eval``; ``chunks`` has ``entity_id``,
    ``ord``, ``txt``, ``did``.  Questions without a positive chunk go.  Answers are
    searched for once per entity; questions meet slices of chunk ids and the places
    found, never texts.
    """
    met = _places(questions, chunks)
    found = F.size("places") > 0
    one = met.where((F.col("slices") == 1) & found)
    # an entity of several slices: a question stays if any of them has a positive
    anywhere = F.max(found).over(Window.partitionBy("qid"))
    many = met.where("slices > 1").withColumn("found", anywhere).where("found").drop("found")
    links = one.unionByName(many).select("qid", "places", F.posexplode("chunks").alias("at", "c"))
    label = F.when(F.array_contains("places", F.col("at")), F.lit(POS)).otherwise(F.lit(NEG))
    return links.select("qid", label.alias("label"), F.col("c.ord").alias("ord"), F.col("c.did").alias("did"))


def label_lists(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, pos_cand_list, neg_cand_list): the links of ``label_chunks`` as lists in the order of ``ord``.

    An entity of one slice gives its questions their lists at once; only questions of
    several slices are grouped, a row for each slice.
    """
    met = _places(questions, chunks)
    side = lambda wanted: F.transform(F.filter("chunks", lambda c, at: F.array_contains("places", at) == wanted), lambda c: c["did"])
    lists = [side(F.lit(True)).alias("pos_cand_list"), side(F.lit(False)).alias("neg_cand_list")]
    one = met.where((F.col("slices") == 1) & (F.size("places") > 0)).select("qid", *lists)
    parts = met.where("slices > 1").select("qid", F.struct("slice", *lists).alias("part"))
    many = parts.groupBy("qid").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = lambda c: F.flatten(F.transform("parts", lambda p: p[c])).alias(c)
    many = many.select("qid", whole("pos_cand_list"), whole("neg_cand_list")).where(F.size("pos_cand_list") > 0)
    return one.unionByName(many)


def _places(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, slice, slices, chunks, places): questions with the slices of their entity and the places of their answers in each."""
    options = F.concat("answer", "answer_eval")
    answers = questions.select("entity_id", F.explode(options).alias("answer"))
    hits = materialize(answer_hits(chunks, answers), "answer-hits")
    met = lookup_join(questions.select("qid", "entity_id", options.alias("options")), whole_slices(hits), "entity_id")
    return met.select("qid", "slice", "slices", "chunks", places_of(F.col("options")).alias("places"))


def number_queries(queries: DataFrame, dataset, position: str = "pos", width: int = BUCKET_ROWS) -> DataFrame:
    """Sequential query ids in source order."""
    return assign_ids(queries, dataset, position, "qid", width=width)


def extend_by_entity(links: DataFrame, pool: DataFrame, other: DataFrame) -> DataFrame:
    """Add the candidates of another pool that share an entity with a positive.

    ``pool`` has ``did``, ``entity_id``; ``other`` has ``entity_id``, ``ord``,
    ``did``.  The added candidates follow the existing ones, each added once.
    """
    positives = links.where(F.col("label") == POS)
    entity = lookup_join(positives, pool.select("did", "entity_id"), "did").select("qid", "ord", "entity_id")
    more = skew_join(
        entity.withColumnRenamed("ord", "__base"),
        other.select("entity_id", F.col("ord").alias("__ord"), "did"),
        "entity_id",
        spread_by=["qid", "__base"],
    )
    new = more.groupBy("qid", "did").agg(F.min(F.struct("__base", "__ord")).alias("__at"))
    return _appended(links, new)


#: queries of one combination of entities that a task joins with its list
LIST_QUERIES = 1000


def extended_lists(links: DataFrame, pool: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, pos_cand_list): the positives that ``extend_by_entity`` gives, as lists.

    An entity's candidates are listed once, and once more for each combination of
    entities that queries have; a query meets its list where it is used.  So what
    is shuffled follows the combinations, not the pairs of query and candidate.
    """
    positives = links.where(F.col("label") == POS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "did"))), lambda s: s["did"])
    own = positives.groupBy("qid").agg(listed.alias("__own"))
    entity = lookup_join(positives, pool.select("did", "entity_id"), "did").where(F.col("entity_id").isNotNull())
    bases = entity.groupBy("qid", "entity_id").agg(F.min("ord").alias("__base"))
    places = F.dense_rank().over(Window.partitionBy("qid").orderBy("__base"))
    combos = bases.select("qid", "entity_id", places.alias("place")).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("place", "entity_id"))).alias("__combo")
    )
    queries = materialize(own.join(combos, "qid", "left"), "extended")
    lists = other.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "did"))).alias("__list"))
    parts = queries.select("__combo").distinct().select("__combo", F.inline("__combo")).join(lists, "entity_id")
    rows = F.flatten(F.collect_list(F.transform("__list", lambda x: F.struct("place", x["ord"].alias("ord"), x["did"].alias("did")))))
    # the first place of a candidate that several entities have counts
    new = parts.groupBy("__combo").agg(rows.alias("__rows")).select(
        "__combo", F.array_distinct(F.transform(F.array_sort("__rows"), lambda s: s["did"])).alias("__new")
    )
    met = skew_join(queries, new, "__combo", "left", LIST_QUERIES, ["qid"], sample=1)
    return met.select("qid", F.concat("__own", F.coalesce("__new", F.array().cast("array<string>"))).alias("pos_cand_list"))


def extend_by_content(links: DataFrame, pool: DataFrame, other: DataFrame) -> DataFrame:
    """Add, per positive, the other pool's candidate with the same content."""
    positives = links.where(F.col("label") == POS)
    keyed = lookup_join(positives, pool.select("did", *content_key(doc_key())), "did")
    found = lookup_join(keyed.select("qid", "ord", *KEY), pool_keys(other), KEY)
    new = found.select("qid", "did", F.struct(F.col("ord").alias("__base"), F.lit(0).alias("__ord")).alias("__at"))
    return _appended(links, new)


def _appended(links: DataFrame, new: DataFrame) -> DataFrame:
    """Old links first (``src`` 0), then the new ones in the order ``__at``."""
    old = links.select(
        "qid", "label", F.lit(0).alias("src"), F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("sub"), "did"
    )
    added = new.select(
        "qid",
        F.lit(POS).alias("label"),
        F.lit(1).alias("src"),
        F.col("__at.__base").cast("long").alias("ord"),
        F.col("__at.__ord").cast("long").alias("sub"),
        "did",
    )
    return old.unionByName(added).select(
        "qid", "label", F.struct("src", "ord", "sub").alias("ord"), "did"
    )
