"""Splits, caps, trims and per-query choices, all reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovekit.functions.stable import SEED, cycled, hash_int, hash_order, pick, shuffled
from trovekit.functions.text import clean_text
from trovekit.operators.numbering import append_ids, number_by_hash, number_by_position, number_rows
from trovekit.operators.pools import chunked_kb_rows, chunked_kb_keys, referenced_ids
from trovekit.operators.skew import null_safe_join
from trovekit.session import materialize, release

#: rows of a group that one task ranks
LARGE_ROWS = 1_000_000


def hash_rank(partition: list[str], key: str, seed=SEED) -> Column:
    """Rank of a row within its group in hash order."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(hash_order(key, seed), key))


def cap_per_group(df: DataFrame, group: list[str] | str, key: str, limit: int, seed=SEED, large_rows: int = LARGE_ROWS) -> DataFrame:
    """At most ``limit`` rows per group, chosen by hash; adds ``rank``.

    Groups are counted first.  Those of up to ``large_rows`` rows are ranked each by
    one task, which passes on ``limit`` rows.  A larger one is cut into hash buckets
    whose number follows from its size: buckets beyond the limit are dropped by
    their counts, the others ranked one by one.  Rows whose group is NULL are a group
    like others.
    """
    group = [group] if isinstance(group, str) else list(group)
    # fewer than one row for each large_rows rows
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > large_rows)
    large = materialize(large, "large-groups")
    whole = lambda rows: rows.withColumn("rank", hash_rank(group, key, seed)).where(F.col("rank") <= limit)
    if large.isEmpty():
        release(large)
        return whole(df)
    small = whole(null_safe_join(df, F.broadcast(large.select(*group)), group, "left_anti"))
    parts = F.ceil(2 * F.col("__n") / large_rows)
    bucket = F.floor(hash_int(key, seed) * parts / F.lit(1 << 32)).alias("__b")
    rows = null_safe_join(df, F.broadcast(large), group).select(*df.columns, bucket)
    sizes = rows.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*group).orderBy("__b")) - F.col("__size")
    needed = sizes.select(*group, "__b", before.alias("__before")).where(F.col("__before") < limit)
    kept = null_safe_join(rows, F.broadcast(needed), [*group, "__b"])
    ranked = kept.withColumn("rank", (hash_rank([*group, "__b"], key, seed) + F.col("__before")).cast("int"))
    return small.unionByName(ranked.where(F.col("rank") <= limit).drop("__b", "__before"))


def split_per_group(
    df: DataFrame, group: str, key: str, train: int, val: int, test: int, seed=SEED, groups: list[str] | None = None
) -> DataFrame:
    """Stratified split: per group the first ``train`` rows, then val, then test."""
    rows = df if groups is None else df.where(F.col(group).isin(groups))
    ranked = cap_per_group(rows, group, key, train + val + test, seed)
    rank = F.col("rank")
    split = F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank")


def hold_out(df: DataFrame, key: str, n: int, seed=SEED, names=("val", "train")) -> DataFrame:
    """Mark the first ``n`` rows in hash order as held out.

    Rows that repeat a key share their fate; they count once for each row.
    """
    held = number_by_hash(df.select(key), key, seed, limit=n).select(key, F.lit(True).alias("__held")).distinct()
    joined = df.join(held, key, "left")
    return joined.withColumn("split", F.when(F.col("__held"), names[0]).otherwise(names[1])).drop("__held")


def hold_out_half(df: DataFrame, key: str, seed=SEED, names=("val", "test")) -> DataFrame:
    """First half (rounded down) in hash order and the rest."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = number_by_hash(df, key, seed, "__n")
    return ranked.withColumn("split", F.when(F.col("__n") <= F.floor(total / 2), names[0]).otherwise(names[1])).drop("__n")


def split_thirds_of_half(df: DataFrame, key: str, position: str = "pos", seed=SEED, half=2, parts=3) -> DataFrame:
    """First ``1/half`` of the rows in file order, shuffled; the first third is
    val, everything from twice a third on is test, the middle is left out."""
    total = df.agg(F.count(F.lit(1))).scalar()
    head_size = F.floor(total / half)
    head = number_by_position(df, position, "__n").where(F.col("__n") <= head_size).drop("__n")
    ranked = number_by_hash(head, key, seed, "__n")
    third = F.floor(head_size / parts)
    split = F.when(F.col("__n") <= third, "val").when(F.col("__n") > third * 2, "test")
    return ranked.withColumn("split", split).drop("__n").where(F.col("split").isNotNull())


def cap_per_entity(
    df: DataFrame, entity: str, key: str, text_limit: int, image_text_limit: int, seed=SEED
) -> DataFrame:
    """Rows per entity capped by the entity's ``modality``; file tags stay."""
    top = cap_per_group(df, entity, key, max(text_limit, image_text_limit), seed)
    limit = F.when(F.col("modality") == "image,text", image_text_limit).otherwise(text_limit)
    return top.where(F.col("rank") <= limit).drop("rank")


def trim_pool(pool: DataFrame, links: DataFrame, others: int, seed=SEED) -> DataFrame:
    """All referenced candidates plus ``others`` sampled ones.

    ``rank`` numbers the result: referenced candidates in file order first,
    then the sample in hash order.
    """
    used = referenced_ids(links)
    referenced = pool.join(used, "did", "left_semi")
    rest = pool.join(used, "did", "left_anti")
    sampled = number_by_hash(rest, "did", seed, "__n", limit=others)
    # Referenced rows are numbered through their position, sampled rows follow.
    rows = referenced.withColumn("__part", F.lit(0)).withColumn("__n", F.col("pos")).unionByName(
        sampled.withColumn("__part", F.lit(1))
    )
    return number_rows(rows, ["__part", "__n"], "rank").drop("__part", "__n")


def augment_pool(
    pool: DataFrame, articles: DataFrame, manifest: DataFrame, dataset, n: int, seed=SEED
) -> DataFrame:
    """``n`` sampled chunks of entities the pool does not have, with new ids.

    ``pool`` has ``entity_id``; ids continue after the pool's rows.  The chunks of all
    articles are only counted; texts are made for entities with a sampled chunk.
    """
    present = pool.select("entity_id").distinct()
    key = F.concat_ws(":", F.col("entity_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_key")
    keys = materialize(chunked_kb_keys(articles, skip=present), "chunk-keys").select("entity_id", key)
    drawn = number_by_hash(keys, "chunk_key", seed, "__pos", limit=n).select("entity_id").distinct()
    drawn = materialize(drawn, "drawn")
    # every chunk among the first n in hash order is one of these entities'
    chunks = chunked_kb_rows(null_safe_join(articles, drawn, ["entity_id"], "left_semi"), manifest)
    chunks = chunks.withColumn("chunk_key", key)
    sampled = number_by_hash(chunks, "chunk_key", seed, "__pos", limit=n)
    return append_ids(pool, sampled, dataset, "__pos", "did").drop("__pos")


def cap_per_modality(queries: DataFrame, limits: dict[str, int], dataset, seed=SEED) -> DataFrame:
    """Cap queries per modality, shuffle and number them anew (``new_qid``)."""
    from trovekit.functions.ids import make_id

    pairs = [F.lit(x) for item in limits.items() for x in item]
    limit = F.try_element_at(F.create_map(*pairs), F.col("query_modality"))
    capped = cap_per_group(queries, "query_modality", "qid", max(limits.values()), seed)
    capped = capped.where(F.col("rank") <= limit).drop("rank")
    numbered = number_by_hash(capped, "qid", f"{seed}/order", "__n")
    return numbered.withColumn("new_qid", make_id(dataset, "__n")).drop("__n")


# -- choices per query ---------------------------------------------------------


def pick_prompt(rows: DataFrame, prompts: DataFrame, key: str = "qid", seed=SEED, drop_missing=False) -> DataFrame:
    """Add a cleaned instruction for (dataset, query modality, candidate modality).

    The prompt table has one row per combination (at most datasets x tasks), so
    it is broadcast by size.  A combination without prompt fails the job unless
    ``drop_missing``.
    """
    joined = rows.join(prompts, ["dataset_id", "query_modality", "cand_modality"], "left")
    chosen = clean_text(pick("prompts", key, seed))
    if drop_missing:
        return joined.withColumn("prompt", chosen).where(F.col("prompt") != "").drop("prompts")
    missing = F.raise_error(
        F.concat_ws(", ", F.lit("no prompt for"), "dataset_id", "query_modality", "cand_modality")
    )
    return joined.withColumn("prompt", F.when(chosen != "", chosen).otherwise(missing)).drop("prompts")


def pick_positive(key: str = "qid", seed=SEED, random: bool = True, column: str = "pos_cand_list") -> Column:
    """One positive per query: hashed choice, or the first."""
    return pick(column, key, seed) if random else F.try_element_at(F.col(column), F.lit(1))


def pick_negatives(n: int, key: str = "qid", seed=SEED, shuffle: bool = True, column: str = "neg_cand_list") -> Column:
    """``n`` negatives, starting over when there are fewer."""
    values = shuffled(column, key, seed) if shuffle else F.col(column)
    return cycled(values, n)


def pick_n_positives(n: int, key: str = "qid", seed=SEED, shuffle: bool = True, column: str = "pos_cand_list") -> Column:
    """Exactly ``n`` (did, place) positives.

    Enough positives: a sample (or the first ``n``).  Too few: all of them in
    order, then hashed repeats.  ``place`` counts distinct positives in order
    of first appearance.
    """
    values = F.col(column)
    distinct = F.array_distinct(values)
    head = F.slice(shuffled(column, key, seed), 1, n) if shuffle else F.slice(values, 1, n)
    pad = F.transform(
        F.sequence(F.size(values) + 1, F.lit(n)),
        lambda i: pick(values, F.concat_ws(":", F.col(key), i.cast("string")), seed),
    )
    chosen = F.when(F.size(values) >= n, head).otherwise(F.concat(values, pad))
    pairs = F.transform(
        chosen, lambda d: F.struct(d.alias("did"), (F.array_position(distinct, d) - 1).cast("int").alias("place"))
    )
    return F.when(F.size(values) > 0, pairs)
