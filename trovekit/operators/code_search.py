"""Retrieval by code: candidates that share a generated code with the query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovekit.functions.codes import code_to_tokens
from trovekit.operators.blocks import BLOCK_ROWS, _found_rows, _Group, _matrix
from trovekit.operators.numbering import position_bucket
from trovekit.operators.skew import MAX_HOT_KEYS, skew_join
from trovekit.operators.stats import number_within
from trovekit.sources.stores import code_place

POOL_SLICE = 500_000
QUERY_SLICE = 4_096


def code_buckets(codes: DataFrame, position: str = "pos") -> DataFrame:
    """(code, at, did): members of each code in input order, 0-based place.

    A code that holds much of the pool is numbered in position ranges.
    """
    numbered = number_within(codes, "code", position_bucket(position), [position], "__n")
    return numbered.select("code", (F.col("__n") - 1).alias("at"), "did")


def retrieve(beams: DataFrame, codes: DataFrame, k: int, dedupe: bool = False, position: str = "pos") -> DataFrame:
    """Members of the generated codes in beam order, cut at ``k``.

    Without ``dedupe`` a candidate reached through two beams counts twice.
    Only the first ``k`` members of a code can ever be used, so a code that
    holds much of the pool is cut before the join; it is numbered in position
    ranges, so no task sorts a whole code whatever ``k``.
    """
    members = code_buckets(codes, position).where(F.col("at") < k).withColumn("__at", (F.col("at") + 1).cast("int"))
    found = skew_join(beams.select("qid", "beam_rank", "code"), members.select("code", "__at", "did"), "code", spread_by=["qid", "beam_rank"])
    if dedupe:
        found = found.groupBy("qid", "did").agg(F.min(F.struct("beam_rank", "__at")).alias("__m")).select(
            "qid", "did", "__m.beam_rank", "__m.__at"
        )
    order = Window.partitionBy("qid").orderBy("beam_rank", "__at")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "did", "rank", (F.lit(1.0) / F.col("rank")).alias("score"))


def _bucket_batches(k: int):
    def emit(group):
        found = group.result() if group else None
        if found is not None:
            q, d, s = found
            yield pa.record_batch(
                {"qid": pa.array(list(q), pa.string()), "did": pa.array(list(d), pa.string()), "score": pa.array(s, pa.float64())}
            )

    def run(batches):
        current, group = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column("key").dictionary_encode()
            index, names = keys.indices.to_numpy(), keys.dictionary
            side = batch.column("side").to_numpy()
            edge = np.flatnonzero((index[1:] != index[:-1]) | (side[1:] != side[:-1])) + 1
            bounds = [0, *edge.tolist(), n]
            for a, b in zip(bounds, bounds[1:]):
                name = names[index[a]].as_py()
                if name != current:
                    yield from emit(group)
                    current, group = name, _Group(k, "cosine")
                part = batch.slice(a, b - a)
                ids = np.array(part.column("id").to_pylist(), object)
                mat = _matrix(part.column("vec"), "<f8")
                if side[a] == 0:
                    group.add_queries(ids, mat)
                else:
                    group.add_pool(ids, mat)
        yield from emit(group)

    return run


def rerank(
    beams: DataFrame,
    codes: DataFrame,
    query_vectors: DataFrame,
    pool_vectors: DataFrame,
    k: int,
    pool_slice: int = POOL_SLICE,
    query_slice: int = QUERY_SLICE,
) -> DataFrame:
    """Distinct members of all generated codes, ranked by cosine, cut at ``k``.

    ``query_vectors``: qid, embedding; ``pool_vectors``: did, embedding (ids as
    text).  Members of a code stream past the queries that generated it and
    only the k best per query leave the task, so no list of pairs is built.
    Hot codes are cut on both sides; every pair still meets exactly once.
    """
    wanted = beams.select("qid", "code").distinct()
    members = codes.select("code", "did").join(wanted.select("code").distinct(), "code", "left_semi")
    slices = _slices(wanted, members, pool_slice, query_slice)
    q = wanted.join(query_vectors.select("qid", "embedding"), "qid").join(F.broadcast(slices), "code", "left")
    p = members.join(pool_vectors.select("did", "embedding"), "did").join(F.broadcast(slices), "code", "left")
    np_, nq = F.coalesce("np", F.lit(1)), F.coalesce("nq", F.lit(1))
    kinds = {d.schema["embedding"].dataType.simpleString() for d in (query_vectors, pool_vectors)}
    vec = F.col("embedding").cast(kinds.pop() if len(kinds) == 1 else "array<double>").alias("vec")

    def places(key, own_slices, other_slices, arrange):
        """Keys ``code/pool slice/query slice`` at which a row takes part."""
        own = F.pmod(F.xxhash64(key), own_slices.cast("long")).cast("string")
        return F.transform(
            F.sequence(F.lit(0), other_slices - 1),
            lambda other: F.concat_ws("/", code_to_tokens("code"), *arrange(own, other.cast("string"))),
        )

    q = q.select(
        F.lit(0).alias("side"),
        F.explode(places("qid", nq, np_, lambda own, other: (other, own))).alias("key"),
        F.col("qid").cast("string").alias("id"),
        vec,
    )
    p = p.select(
        F.lit(1).alias("side"),
        F.explode(places("did", np_, nq, lambda own, other: (own, other))).alias("key"),
        F.col("did").cast("string").alias("id"),
        vec,
    )
    met = q.unionByName(p).repartition("key").sortWithinPartitions("key", "side")
    schema = T.StructType(
        [T.StructField("qid", T.StringType()), T.StructField("did", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    scored = met.mapInArrow(_bucket_batches(k), schema)
    unique = scored.groupBy("qid", "did").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    ranked = unique.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", "did", "rank", "score")


def rerank_stored(beams: DataFrame, stored: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """``rerank`` over vectors that lie by their codes (``read_vectors_by_code``).

    The queries of a code are packed into blocks, which are sent to the places of the
    code; the pool is read where it lies and packed there.  Blocks meet blocks, so no
    pair is a row; a task passes on k rows per query and place.
    """
    many = F.broadcast(stored.where("places > 1").select("code", "places").distinct())
    wanted = beams.select("qid", "code").distinct()
    # fewer than one row for each BLOCK_ROWS queries
    crowded = wanted.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    asked = wanted.join(query_vectors.select("qid", "embedding"), "qid").join(F.broadcast(crowded), "code", "left")
    part = F.pmod(F.xxhash64("qid"), F.coalesce("blocks", F.lit(1))).alias("part")
    block = F.collect_list(F.struct(F.col("qid").cast("string").alias("id"), F.col("embedding").alias("vec")))
    sent = asked.groupBy("code", part).agg(block.alias("q")).join(many, "code", "left")
    sent = sent.withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)))
    sent = sent.select(code_place("code", "place").alias("key"), "part", "q")
    held = F.collect_list(F.struct(F.col("did").cast("string").alias("id"), F.col("embedding").alias("vec")))
    met = sent.join(stored.groupBy("key", "block").agg(held.alias("p")).hint("merge"), "key")
    scored = met.select("key", "part", "q", "p").mapInArrow(_met_blocks(k), "qid string, did string, score double")
    unique = scored.groupBy("qid", "did").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    ranked = unique.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", "did", "rank", "score")


def _met_blocks(k: int):
    """Rows (key, part, block of queries, block of the pool); rows of one block of queries follow each other."""

    def unpack(block):
        ids, vectors = block.values.flatten()
        return np.array(ids.to_pylist(), object), _matrix(vectors, "<f8")

    def run(batches):
        current, queries, groups = None, None, []
        for batch in batches:
            names, parts = batch.column("key").to_pylist(), batch.column("part").to_pylist()
            for i, at in enumerate(zip(names, parts)):
                if at != current:
                    for group in groups:
                        yield from _found_rows(group, pa.string(), pa.string())
                    current, queries, groups = at, unpack(batch.column("q")[i]), []
                ids, mat = unpack(batch.column("p")[i])
                for turn, rows in enumerate(_turns(ids)):
                    if turn == len(groups):
                        groups.append(_Group(k, "cosine"))
                        groups[turn].add_queries(*queries)
                    groups[turn].add_pool(ids[rows], mat[rows])
        for group in groups:
            yield from _found_rows(group, pa.string(), pa.string())

    return run


def _turns(ids: np.ndarray) -> list[np.ndarray]:
    """Rows in turns that hold an id once; a candidate stored several times must not fill a list alone."""
    _, same = np.unique(ids, return_inverse=True)
    order = np.argsort(same, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order], side="left")
    return [np.sort(order[place == turn]) for turn in range(place.max(initial=-1) + 1)]


def _slices(wanted: DataFrame, members: DataFrame, pool_slice: int, query_slice: int) -> DataFrame:
    """Cuts of hot codes: (code, np, nq).

    A hot code holds more than one ``MAX_HOT_KEYS``-th of a side, so there are
    fewer than ``2 * MAX_HOT_KEYS`` of them.
    """
    sides = wanted.select("code", F.lit(1).alias("q"), F.lit(0).alias("p")).unionByName(
        members.select("code", F.lit(0).alias("q"), F.lit(1).alias("p"))
    )
    counts = sides.groupBy("code").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    all_q, all_p = sides.agg(F.sum("q"), F.sum("p")).first()
    least_p, least_q = max(pool_slice, (all_p or 0) / MAX_HOT_KEYS), max(query_slice, (all_q or 0) / MAX_HOT_KEYS)
    hot = counts.where((F.col("p") > least_p) | (F.col("q") > least_q))
    return hot.select(
        "code",
        F.ceil(F.greatest(F.col("p"), F.lit(1)) / pool_slice).cast("int").alias("np"),
        F.ceil(F.greatest(F.col("q"), F.lit(1)) / query_slice).cast("int").alias("nq"),
    )
