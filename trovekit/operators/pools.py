"""Candidate pools: first-seen dedup, builders, set operations and checks.

Builders take an explicit order column (``pos``); file order is never taken
from the partition layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovekit import constants as K
from trovekit.functions.ids import id_number, make_id
from trovekit.functions.text import chunk_words, clean_text, doc_key, title_body, truncate_words, word_count
from trovekit.operators.numbering import ROW, number_rows, number_stored, stored_rows
from trovekit.operators.skew import SLICE_ROWS, hot_keys, null_safe_join
from trovekit.session import materialize
from trovekit.sources.images import demote_invalid_image, with_valid_image


# -- uniqueness and duplicates -------------------------------------------------


def first_seen(df: DataFrame, keys, order, stored: bool = True) -> DataFrame:
    """First row per key in the given order.

    Rows are written once.  Only a 128-bit hash of the key, the order and the row's
    number are aggregated, every task reducing its rows before the shuffle, so a key
    that holds most of the data costs one narrow row per task; the first rows are
    fetched by their numbers.  Of rows that tie one stays.

    ``stored=False`` is for rows that are short and cheap to read (``order`` then names
    columns): nothing is written, and whole rows move once, to the place of their key,
    where joins on the key find them without a further shuffle.
    """
    if not stored:
        return _first_in_place(df, keys, order)
    rows, first = _first_rows(df, keys, order)
    return rows.join(first, ROW).select(*df.columns)


def _first_in_place(df: DataFrame, keys, order, slice_rows: int = SLICE_ROWS) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rows = df
    hot = hot_keys(df.select(*keys, *order), keys, slice_rows, order).select(*keys)
    if not hot.isEmpty():
        # of a key that holds much of the table only the rows at its first place move
        place = F.struct(*order)
        of_hot = null_safe_join(df.select(*keys, *order), F.broadcast(hot), keys)
        least = of_hot.groupBy(*keys).agg(F.min(place).alias("__least"))
        rows = null_safe_join(df, F.broadcast(least), keys, "left")
        rows = rows.where(F.col("__least").isNull() | place.eqNullSafe(F.col("__least")))
    # dealt before the window, so that tasks do not sort their rows both before and after it
    rows = rows.select(*df.columns).repartition(*keys)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__at", at).where(F.col("__at") == 1).drop("__at")


def first_seen_numbered(df: DataFrame, keys, order, by, out: str = "__n") -> DataFrame:
    """``first_seen`` with a number ``out`` from 1 in the order ``by``; whole rows move once."""
    rows, first = _first_rows(df, keys, order)
    by = [F.col(o) if isinstance(o, str) else o for o in by]
    places = rows.select(ROW, *[o.alias(f"__by{i}") for i, o in enumerate(by)]).join(first, ROW)
    numbers = number_stored(materialize(places, "places"), [f"__by{i}" for i in range(len(by))], out)
    return rows.join(numbers, ROW).select(*df.columns, out)


def _first_rows(df: DataFrame, keys, order) -> tuple[DataFrame, DataFrame]:
    """(stored rows, ROW of the first row of each key)"""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    rows = stored_rows(df, "seen")
    place = order[0] if len(order) == 1 else F.struct(*order)
    place = F.col(place) if isinstance(place, str) else place
    narrow = rows.select(*_hashes(keys), place.alias("__place"), ROW)
    kind = narrow.schema["__place"].dataType
    fixed = isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) and not isinstance(kind, T.DecimalType)
    if not fixed:
        narrow = narrow.withColumn("__place", F.struct("__place"))  # a NULL place comes first
        return rows, narrow.groupBy("__h", "__g").agg(F.min_by(ROW, "__place").alias(ROW)).select(ROW)
    # a fixed-width place is aggregated in a hash table
    lost = F.min(F.when(F.col("__place").isNull(), F.col(ROW)))
    best = narrow.groupBy("__h", "__g").agg(F.coalesce(lost, F.min_by(ROW, "__place")).alias(ROW))
    return rows, best.select(ROW)


def _hashes(keys: list[str]) -> list[Column]:
    """128 bits of the key columns: equal keys have equal ones, different keys are told apart."""
    return [F.xxhash64(*_marked(keys)).alias("__h"), F.xxhash64(F.lit("second"), *_marked(keys)).alias("__g")]


def _marked(keys: list[str]) -> list[Column]:
    """Key columns each with a flag, so a NULL and a shifted value hash differently."""
    return [c for k in keys for c in (F.col(k), F.col(k).isNull())]


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def ensure_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; raises when ``key`` repeats (runs one aggregate)."""
    bad = repeated_keys(df, key).limit(1).collect()
    if bad:
        raise ValueError(f"duplicate {key}: {bad[0][key]!r}")
    return df


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: row count, distinct keys and whether they agree."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    ).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def later_duplicates(df: DataFrame, key: Column, order: str = "pos") -> DataFrame:
    """Rows after the first one of their key, with the key; NULL and "" skipped.

    The first row is found by a 128-bit hash of the key, so a key that is a whole text
    moves only where the caller reads it.
    """
    keyed = df.withColumn("key", key).where(F.col("key").isNotNull() & (F.col("key") != ""))
    keyed = keyed.select("key", *[c for c in keyed.columns if c != "key"], *_hashes(["key"]))
    first = keyed.groupBy("__h", "__g").agg(F.min(order).alias("__first"))
    return keyed.join(first, ["__h", "__g"]).where(F.col(order) > F.col("__first")).drop("__h", "__g", "__first")


def duplicate_candidates(pool: DataFrame, order: str = "pos") -> DataFrame:
    return later_duplicates(pool, doc_key(), order)


# -- builders ------------------------------------------------------------------


def _candidate(kind: str, txt: Column, img: Column, modality: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        txt.cast("string").alias("txt"),
        img.cast("string").alias("img_path"),
        F.lit(modality).alias("modality"),
    )


def number_candidates(rows: DataFrame, dataset, order, position: str = "pos") -> DataFrame:
    """Give candidates sequential ids in the order (position, *order)."""
    numbered = number_rows(rows, [position, *order], "__n")
    return numbered.withColumn("did", make_id(dataset, "__n")).drop("__n")


def text_image_pool(raw: DataFrame, dataset, source_content: Column | None = None) -> DataFrame:
    """Pool with a text and an image candidate per raw row.

    ``raw`` has ``pos``, ``caption``, ``img_path``.  The text comes first;
    texts and images are deduplicated separately, first seen wins.
    """
    content = F.lit(None).cast("string") if source_content is None else source_content
    both = F.array(
        _candidate(K.TEXT, clean_text("caption"), F.lit(None), K.TEXT),
        _candidate(K.IMAGE, F.lit(None), F.col("img_path"), K.IMAGE),
    )
    rows = raw.select("pos", content.alias("src_content"), F.posexplode(both).alias("part", "c"))
    rows = rows.select("pos", "part", "src_content", "c.modality", F.coalesce("c.txt", "c.img_path").alias("value"))
    # rows of one modality have one part, so the position alone tells the first
    unique = first_seen_numbered(rows.where(F.col("value") != ""), ["modality", "value"], "pos", ["pos", "part"])
    return unique.select(
        "pos",
        make_id(dataset, "__n").alias("did"),
        F.when(F.col("modality") == K.TEXT, F.col("value")).alias("txt"),
        F.when(F.col("modality") == K.IMAGE, F.col("value")).alias("img_path"),
        "modality",
        "src_content",
    )


def split_subpools(raw: DataFrame, dataset) -> tuple[DataFrame, DataFrame]:
    """Global pool over all splits, and (split, modality, did) sub-pool members."""
    pool = text_image_pool(raw, dataset)
    texts = raw.select("split", clean_text("caption").alias("value"), F.lit(K.TEXT).alias("modality"))
    images = raw.select("split", F.col("img_path").alias("value"), F.lit(K.IMAGE).alias("modality"))
    used = texts.unionByName(images).distinct()
    ids = pool.select("did", "modality", F.coalesce("txt", "img_path").alias("value"))
    return pool, used.join(ids, ["modality", "value"]).select("split", "modality", "did")


def pair_pool(parts: list[DataFrame], dataset, manifest: DataFrame | None = None) -> DataFrame:
    """Pool of (image, text) pairs from several lists, in list order.

    Every part has ``pos``, ``caption``, ``img_path`` and ``src_content``;
    pairs with an empty text or an unreadable image are left out.
    """
    tagged = [
        p.select(F.lit(i).alias("part"), "pos", clean_text("caption").alias("txt"), "img_path", "src_content")
        for i, p in enumerate(parts)
    ]
    rows = reduce(DataFrame.unionByName, tagged).where(F.col("txt") != "")
    if manifest is not None:
        rows = with_valid_image(rows, manifest)
    numbered = first_seen_numbered(rows, ["txt", "img_path"], ["part", "pos"], ["part", "pos"])
    return numbered.select(
        make_id(dataset, "__n").alias("did"), "txt", "img_path", F.lit(K.IMAGE_TEXT).alias("modality"), "src_content"
    )


def fact_pool(parts: list[DataFrame], dataset, manifest: DataFrame | None = None) -> DataFrame:
    """Pool of text facts and (image, text) facts from several lists, in order.

    Every part has ``pos``, ``place`` (order inside a source row), ``caption``,
    ``img_path`` (NULL for a text fact) and ``src_content``.  Facts without
    text go; texts and pairs are deduplicated separately.
    """
    tagged = [
        p.select(F.lit(i).alias("part"), "pos", "place", clean_text("caption").alias("txt"), "img_path", "src_content")
        for i, p in enumerate(parts)
    ]
    rows = reduce(DataFrame.unionByName, tagged).where(F.col("txt") != "")
    if manifest is not None:
        # text facts have no image to check
        pairs = with_valid_image(rows.where(F.col("img_path").isNotNull()), manifest)
        rows = rows.where(F.col("img_path").isNull()).unionByName(pairs)
    modality = F.when(F.col("img_path").isNull(), F.lit(K.TEXT)).otherwise(F.lit(K.IMAGE_TEXT))
    order = ["part", "pos", "place"]
    numbered = first_seen_numbered(rows.withColumn("modality", modality), ["modality", "txt", "img_path"], order, order)
    return numbered.select(make_id(dataset, "__n").alias("did"), "txt", "img_path", "modality", "src_content")


def image_pool(images: DataFrame, dataset, manifest: DataFrame | None = None) -> DataFrame:
    """Image-only pool in path order."""
    rows = images.select("img_path").distinct()
    if manifest is not None:
        rows = with_valid_image(rows, manifest)
    numbered = number_rows(rows, ["img_path"], "__n")
    return numbered.select(
        make_id(dataset, "__n").alias("did"),
        F.lit(None).cast("string").alias("txt"),
        "img_path",
        F.lit(K.IMAGE).alias("modality"),
        F.lit(None).cast("string").alias("src_content"),
    )


def _articles(articles: DataFrame, manifest: DataFrame) -> DataFrame:
    return demote_invalid_image(articles.withColumn("modality", F.lit(None).cast("string")), manifest)


def _entity_content() -> Column:
    return F.to_json(F.struct(F.col("entity_id").cast("string").alias("wikidata_id"), F.col("title").alias("wikipedia_title")))


def kb_pool(articles: DataFrame, manifest: DataFrame, dataset) -> DataFrame:
    """One candidate per entity: title and the first 100 words of its text.

    ``articles`` has ``pos``, ``entity_id``, ``title``, ``content``,
    ``img_path`` (NULL without image).
    """
    # whole contents are neither written nor moved
    articles = articles.select("pos", "entity_id", "title", truncate_words("content").alias("content"), "img_path")
    rows = _articles(first_seen(articles, "entity_id", "pos"), manifest)
    rows = rows.withColumn("txt", title_body("title", "content")).where(F.col("txt") != "").drop("content")
    return number_candidates(rows.withColumn("src_content", _entity_content()), dataset, []).select(
        "pos", "entity_id", "did", "txt", "img_path", "modality", "src_content"
    )


def _without_entities(articles: DataFrame, skip: DataFrame | None) -> DataFrame:
    return articles if skip is None else articles.join(skip.select("entity_id"), "entity_id", "left_anti")


def chunked_kb_keys(articles: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(entity_id, chunk): the keys of the rows of ``chunked_kb_rows``, counted without making the texts."""
    cleaned = _without_entities(articles, skip).select("entity_id", clean_text("content").alias("content"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / K.CHUNK_WORDS).cast("int") - 1))
    # the words are counted once, by way of a one-element array
    return cleaned.select("entity_id", F.explode(F.get(F.transform(F.array(word_count("content")), numbers), F.lit(0))).alias("chunk"))


def chunked_kb_rows(articles: DataFrame, manifest: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """One row per 100-word piece of every article with text, title repeated.

    ``skip`` lists entity ids to leave out.
    """
    rows = _articles(_without_entities(articles, skip), manifest)
    # a column of its own below the generator: compiled, and cleaned once per row
    rows = rows.withColumn("content", clean_text("content"))
    pieces = rows.select(
        "pos",
        "entity_id",
        "title",
        "img_path",
        "modality",
        F.posexplode(chunk_words("content")).alias("chunk", "piece"),
    )
    return pieces.withColumn("txt", title_body("title", "piece")).withColumn("src_content", _entity_content())


def chunked_kb_pool(articles: DataFrame, manifest: DataFrame, dataset, skip: DataFrame | None = None) -> DataFrame:
    rows = chunked_kb_rows(articles, manifest, skip)
    return number_candidates(rows, dataset, ["chunk"]).select(
        "pos", "chunk", "entity_id", "did", "txt", "img_path", "modality", "src_content"
    )


# -- set operations between pools ---------------------------------------------


def union_pools(pools: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)


def override_merge(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Rows of both pools; on equal keys the second pool wins."""
    return override.unionByName(base.join(override.select(key), key, "left_anti").select(base.columns))


def referenced_ids(links: DataFrame) -> DataFrame:
    """Distinct candidate ids of (qid, label, ord, did) links."""
    return links.select("did").distinct()


def train_pool(pool: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates that training queries refer to."""
    return pool.join(referenced_ids(links), "did", "left_semi")


def in_id_order(pool: DataFrame, key: str = "did") -> DataFrame:
    """Range-partitioned and sorted by the number part of the id."""
    return pool.orderBy(id_number(key), key)


def conflicting_candidates(rows: DataFrame, key: str = "did") -> DataFrame:
    """Ids that stand for two different contents."""
    content = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.count_distinct(content).alias("n_contents")).where(F.col("n_contents") > 1)


def task_of_candidate(pool: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """Add ``task`` by modality; a modality without a task fails the job."""
    pairs = [F.lit(x) for item in tasks.items() for x in item]
    task = F.try_element_at(F.create_map(*pairs), F.col("modality"))
    unknown = F.raise_error(F.concat(F.lit("unknown candidate modality: "), F.coalesce("modality", F.lit("NULL"))))
    return pool.withColumn("task", F.when(task.isNotNull(), task).otherwise(unknown))


def write_pools(pool: DataFrame, path: str) -> None:
    """Store pools in folders by pool and modality, so task pools prune files."""
    pool.write.mode("overwrite").partitionBy("pool", "modality").parquet(path)


# -- renumbering ---------------------------------------------------------------


def renumber_pool(pool: DataFrame, dataset, order) -> DataFrame:
    """New sequential ids; the previous id stays as ``old_did``."""
    numbered = number_rows(pool.withColumnRenamed("did", "old_did"), order, "__n")
    return numbered.withColumn("did", make_id(dataset, "__n")).drop("__n")


def rewrite_links(links: DataFrame, renumbered: DataFrame) -> DataFrame:
    """Links with new candidate ids; a link to a missing candidate fails the job."""
    mapping = renumbered.select("old_did", F.col("did").alias("__new"))
    joined = links.join(mapping, links["did"] == mapping["old_did"], "left")
    missing = F.raise_error(F.concat(F.lit("link to a candidate that is not in the pool: "), F.coalesce("did", F.lit("NULL"))))
    return joined.withColumn("did", F.coalesce("__new", missing)).select(links.columns)
