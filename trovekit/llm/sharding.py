"""Sharding by fixed virtual slots.

A record belongs for ever to one of some thousand slots, chosen by a hash of its
id and text, so rows of one id (or none) with different texts spread.  Bytes are added up per slot, and a small versioned table says which shard
holds which slot.  Rebalancing edits that table only: records never change their
slot, and a new version moves whole slots from heavy to light shards.

Law: ``bytes``; shard sizes are near equal.  Only the table of slots (a fixed
number of rows) reaches the driver.

Edge cases: NULL text counts 0 bytes and hashes as the empty text, a NULL id as
an empty one; repeated rows stay separate records, REPEATS of them to a slot; an empty table gives an
empty result and the plain map; other columns are ignored, or handed through by
``shard_documents`` whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovekit.llm.common import drop, each_time, running_total, split_buckets, written
from trovekit.session import scratch_path

SLOTS = 8192
REPEATS = 64


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def _slotted(rows: DataFrame, slots: int) -> DataFrame:
    """Written ``rows`` (_key, _row and others) with their virtual slot; every REPEATS equal rows get another one."""
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(slots)).cast("int")
    often = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > REPEATS).select("_key")
    many = written(rows.select("_key", "_row").join(often, "_key", "left_semi").withColumn("_part", F.col("_row") % 1024).withColumn("_one", F.lit(1)), "repeats")
    if many.isEmpty():
        drop(many)
        return rows.withColumn("virtual_slot", slot("_key"))
    numbered = running_total(many, "_one", ["_key"], "_part", ["_row"], "_n")
    blocks = numbered.select("_row", F.floor((F.col("_n") - 1) / REPEATS).alias("_block")).filter("_block > 0")
    placed = rows.join(blocks, "_row", "left")
    return placed.withColumn("virtual_slot", F.when(F.col("_block").isNull(), slot("_key")).otherwise(slot("_key", "_block"))).drop("_block")


def record_size(text: Column | str = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(c), F.lit(0)) + 16).cast("long")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt round."""
    return [s % shards for s in range(slots)]


def rebalance(placed: list[int], weight: dict[int, int], shards: int, tolerance: float = 1e-4) -> list[int]:
    """A map edited so that shard weights come near each other.

    Takes a slot, or trades one for a lighter one, between the heaviest and the
    lightest shard as long as that narrows their gap.
    """
    placed = list(placed)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(placed):
        w = weight.get(slot, 0)
        load[shard] += w
        if w:
            held[shard].append((w, slot))
    for h in held:
        h.sort()
    goal = tolerance * max(1, sum(load)) / shards
    for _ in range(4 * len(placed)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        if gap <= max(1, goal):
            break
        best = (gap, None, None)
        mine, theirs = held[high], held[low]
        for give in mine:
            for back in (None, *_near(theirs, give[0] - gap / 2)):
                moved = give[0] - (back[0] if back else 0)
                if 0 < moved < gap and abs(gap - 2 * moved) < best[0]:
                    best = (abs(gap - 2 * moved), give, back)
        if best[1] is None:
            break
        for entry, src, dst in ((best[1], high, low), (best[2], low, high)):
            if entry:
                held[src].remove(entry)
                insort(held[dst], entry)
                load[src] -= entry[0]
                load[dst] += entry[0]
                placed[entry[1]] = dst
    return placed


def _near(entries: list[tuple[int, int]], wanted: float) -> list[tuple[int, int]]:
    at = bisect_left(entries, (wanted, -1))
    return entries[max(0, at - 1) : at + 1]


def save_map(spark: SparkSession, path: str, version: int, placed: list[int]) -> None:
    """Add a version to the map table at ``path``; writing a version again replaces it."""
    rows = [(i, s) for i, s in enumerate(placed)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of one version, the newest by default."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).select("virtual_slot", "shard")


def balanced_map(sizes: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Write the plain map and its rebalanced edit for ``sizes`` (virtual_slot, size); return the edit."""
    spark = sizes.sparkSession
    weight = {r[0]: r[1] for r in sizes.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    plain = first_map(shards, slots)
    save_map(spark, path, 1, plain)
    save_map(spark, path, 2, rebalance(plain, weight, shards))
    return load_map(spark, path, 2)


def assign(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard, virtual_slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select("doc_id", record_size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key().alias("_key"), F.monotonically_increasing_id().alias("_row")),
        "shard-sizes",
    )
    # a slot's rows are numbered in hash order, a bucket of hashes at a time
    bits = split_buckets(rows.count() // slots).bit_length() - 1
    bucket = F.shiftright("_key", 64 - bits) if bits else F.lit(0)
    rows = written(_slotted(rows, slots).withColumn("_b", bucket.cast("long")).withColumn("_one", F.lit(1)), "shard-slots")
    placed = balanced_map(rows, shards, map_path or scratch_path(spark, "slot-map"), slots)
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for each slot: small whatever the data
    offsets = placed.join(counts, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        running_total(rows, "_one", ["virtual_slot"], "_b", ["_key", "doc_id", "text_crc32", "size", "_row"], "_at")
        .join(F.broadcast(offsets), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("_at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``virtual_slot`` (columns of these names are replaced).

    Only keys and sizes are gathered to make the map; the texts stay where they are
    read.  Of a key with more than REPEATS rows every REPEATS equal rows get a slot,
    and only those rows move.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "virtual_slot")
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(slots)).cast("int").alias("virtual_slot")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("held"), _key().alias("key"), record_size().alias("size"), F.md5(F.to_json(whole)).alias("ident"))
    counts = written(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    often = written(counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > REPEATS).select("key"), "shard-often")
    if often.isEmpty():
        drop(often)
        sizes = counts.select((F.col("size") * F.col("n")).alias("size"), slot("key"))
        placed = rows.select("held", slot("key"))
    else:
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS).cast("long"))).alias("block")
        here = F.least(F.lit(REPEATS), F.col("n") - F.col("block") * REPEATS)
        many = rows.join(often, "key", "left_semi")
        same = many.groupBy("key", "size", "ident").agg(F.count(F.lit(1)).alias("n")).select("*", blocks)
        sizes = counts.join(often, "key", "left_anti").select((F.col("size") * F.col("n")).alias("size"), slot("key"))
        sizes = written(sizes.unionByName(same.select((F.col("size") * here).alias("size"), slot("key", "ident", "block"))), "shard-sizes")
        drop(counts)
        one = many.groupBy("key", "ident").agg(F.first("held").alias("held"), F.count(F.lit(1)).alias("n")).select("*", blocks)
        again = each_time(one.select("held", slot("key", "ident", "block"), here.alias("times")), "times")
        placed = rows.join(often, "key", "left_anti").select("held", slot("key")).unionByName(again)
    shard_of = balanced_map(sizes, shards, map_path or scratch_path(spark, "slot-map"), slots)
    drop(sizes)
    return placed.join(F.broadcast(shard_of), "virtual_slot").select("held.*", "virtual_slot", "shard")
