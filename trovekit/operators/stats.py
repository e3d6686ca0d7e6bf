"""Statistics of pools, queries and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovekit import constants as K
from trovekit.functions.text import word_count
from trovekit.operators.links import explode_links
from trovekit.operators.skew import chunked_running_sum, null_safe_join


def pool_counts(pool: DataFrame) -> DataFrame:
    """Rows per modality; rows without modality are not counted."""
    known = pool.where(F.col("modality").isNotNull() & (F.col("modality") != ""))
    return known.groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


def _typed_links(queries: DataFrame, pool: DataFrame) -> DataFrame:
    links = explode_links(queries, ["query_modality"])
    cand = pool.select("did", F.col("modality").alias("cand_modality"), word_count("txt").alias("n_words"))
    joined = links.join(cand, "did")
    return joined.withColumn("pair", F.concat("query_modality", F.lit("-"), F.col("cand_modality")))


def modality_stats(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Per (pos/neg, modality pair): links, queries whose first candidate has
    the pair, distinct queries, distinct candidates.

    Distinct counts go through one row per (pair, query) and (pair, candidate).
    """
    links = _typed_links(queries, pool)
    per_query = links.groupBy("label", "pair", "qid").agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("ord") == 0).cast("long")).alias("first")
    )
    by_query = per_query.groupBy("label", "pair").agg(
        F.sum("c").alias("examples"), F.sum("first").alias("queries"), F.count(F.lit(1)).alias("unique_queries")
    )
    by_doc = links.select("label", "pair", "did").distinct().groupBy("label", "pair").agg(
        F.count(F.lit(1)).alias("unique_docs")
    )
    return by_query.join(by_doc, ["label", "pair"])


def dataset_averages(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: candidates per query and words per query / candidate text."""
    q = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(word_count("query_txt")).alias("query_words"),
        F.sum(F.size("pos_cand_list")).alias("n_pos"),
        F.sum(F.size("neg_cand_list")).alias("n_neg"),
    )
    c = _typed_links(queries, pool).agg(
        F.sum(F.when(F.col("label") == "pos", F.col("n_words"))).alias("pos_words"),
        F.sum(F.when(F.col("label") == "neg", F.col("n_words"))).alias("neg_words"),
    )
    one = F.lit(1).alias("__one")
    both = q.select("*", one).join(c.select("*", one), "__one")
    return both.select(
        F.try_divide("n_pos", "n").alias("avg_pos_cand_count"),
        F.try_divide("n_neg", "n").alias("avg_neg_cand_count"),
        F.try_divide("query_words", "n").alias("avg_query_txt_words"),
        F.try_divide("pos_words", "n_pos").alias("avg_pos_txt_words"),
        F.coalesce(F.try_divide("neg_words", "n_neg"), F.lit(0.0)).alias("avg_neg_txt_words"),
    )


def mixed_positives(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Queries whose positives have more than one modality."""
    links = _typed_links(queries, pool).where(F.col("label") == "pos")
    per_query = links.groupBy("qid").agg(F.count_distinct("cand_modality").alias("n_modalities"))
    return per_query.where(F.col("n_modalities") > 1)


def question_types(queries: DataFrame, field: str = "question_type") -> DataFrame:
    kind = F.get_json_object("query_src_content", f"$.{field}")
    return queries.select(kind.alias("question_type")).where(F.coalesce("question_type", F.lit("")) != "").groupBy(
        "question_type"
    ).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, smallest and largest word count per text column, in one pass."""
    counted = df.select(*[word_count(c).alias(c) for c in columns])
    stats = counted.agg(
        *[
            f(c).alias(f"{c}__{name}")
            for c in columns
            for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(f"{c}__avg").alias("avg_words"),
                F.col(f"{c}__min").cast("long").alias("min_words"),
                F.col(f"{c}__max").cast("long").alias("max_words"),
            )
            for c in columns
        ]
    )
    return stats.select(F.inline(rows))


def entity_stats(rows: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Rows per entity, overall (modality ``all``) and per modality."""
    per_modality = rows.groupBy("modality", entity).agg(F.count(F.lit(1)).alias("c"))
    whole = per_modality.groupBy(entity).agg(F.sum("c").alias("c")).select(entity, "c", F.lit("all").alias("modality"))
    named = per_modality.where(F.col("modality").isNotNull() & (F.col("modality") != "all"))
    spread = whole.unionByName(named.select(entity, "c", "modality"))
    return spread.groupBy("modality").agg(
        F.sum("c").alias("total"),
        F.avg("c").alias("avg_rows"),
        F.max("c").alias("max_rows"),
        F.min("c").alias("min_rows"),
        F.count(F.lit(1)).alias("entities"),
    )


def qrel_stats(qrels: DataFrame) -> DataFrame:
    """Judged queries and relevant candidates per query."""
    per_query = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("c"))
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("c").alias("relevant"), F.avg("c").alias("avg_relevant")
    )


def caption_counts(rows: DataFrame) -> DataFrame:
    """Images and captions per split; ``rows`` has ``split``, ``image``, ``captions``."""
    per_image = rows.groupBy("split", "image").agg(F.sum(F.size("captions")).alias("c"))
    return per_image.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.sum("c").alias("captions")
    )


def rolling_meter(
    df: DataFrame, meter: str, order: list[str], value: str, window: int = K.METER_WINDOW, width: int = 100_000, position: str = "n"
) -> DataFrame:
    """Statistics of the last ``window`` values of each meter.

    ``position`` is a dense 1-based number within the meter.  A long meter is
    cut into chunks, each carrying the ``window - 1`` rows before it, so no
    task has to hold a whole meter.  The median is the lower one.
    """
    halo = window - 1
    if width < halo:
        raise ValueError(f"a chunk of {width} rows is shorter than the {halo} rows before a window")
    index = F.col(position) - 1
    chunk = F.floor(index / width)
    spill = F.pmod(index, F.lit(width)) >= width - halo
    placed = df.withColumn(
        "__chunk", F.explode(F.when(spill, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    ).withColumn("__own", F.col("__chunk") == chunk)
    frame = Window.partitionBy(meter, "__chunk").orderBy(position).rowsBetween(-halo, 0)
    values = F.sort_array(F.collect_list(value).over(frame))
    return (
        placed.withColumn("median", F.element_at(values, F.floor((F.size(values) + 1) / 2).cast("int")))
        .withColumn("avg", F.avg(value).over(frame))
        .withColumn("max", F.max(value).over(frame))
        .where("__own")
        .select(meter, *order, position, F.col(value).alias("last"), "median", "avg", "max")
    )


def number_within(df: DataFrame, key: str, bucket, order: list[str], out: str = "n") -> DataFrame:
    """Dense 1-based position within each key.

    ``bucket`` is an integer column that follows the order inside a key; rows
    are ranked bucket by bucket and bucket sizes are summed up per key.
    """
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(key).orderBy("__b")) - F.col("__size")
    offsets = sizes.select(key, "__b", before.alias("__before"))
    local = F.row_number().over(Window.partitionBy(key, "__b").orderBy(*order))
    return null_safe_join(rows.withColumn("__local", local), offsets, [key, "__b"]).withColumn(
        out, (F.col("__before") + F.col("__local")).cast("long")
    ).drop("__b", "__local", "__before")


def global_averages(df: DataFrame, meter: str, value: str, weight: str | None = None) -> DataFrame:
    """Count-weighted mean per meter."""
    w = F.lit(1) if weight is None else F.col(weight)
    return df.groupBy(meter).agg(
        F.sum(w).cast("long").alias("count"), F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("global_avg")
    )


def running_count(df: DataFrame, key: str, position: str, out: str = "count") -> DataFrame:
    return chunked_running_sum(df, key, position, F.lit(1), out)


def argmax_accuracy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Share of rows whose largest logit is at the label."""
    from trovekit.functions.vectors import argmax

    hit = (argmax(logits) == F.col(label)).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("hits"), F.avg(hit).alias("accuracy"))
