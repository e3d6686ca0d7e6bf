"""Parquet stores of vectors: embeddings, features, by code, keyed unions and pairs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovekit import schemas
from trovekit.functions.codes import code_to_tokens
from trovekit.operators.blocks import BLOCK_ROWS


def write_embeddings(df: DataFrame, path: str, pool: str) -> None:
    """Store (id, embedding) rows as one pool; pools are partition folders.

    The pool's own folder is replaced, so a job that is run again leaves the same
    rows; other pools stay.
    """
    rows = df.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    rows.write.mode("overwrite").parquet(f"{path}/pool={pool}")


def read_embeddings(spark: SparkSession, path: str, pool: str | None = None) -> DataFrame:
    """Stored vectors of one pool (only its folder is read) or of all pools."""
    schema = schemas.T.StructType(schemas.EMBEDDING.fields + [schemas.T.StructField("pool", schemas.T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows if pool is None else rows.where(F.col("pool") == pool)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.FEATURE.fields]
    df.select(*cast).write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEATURE).parquet(path)


def write_vectors_by_code(codes: DataFrame, vectors: DataFrame, path: str, buckets: int | None = None, slice_rows: int = 500_000) -> None:
    """Store the vectors of a pool by their codes, in hash buckets of the code.

    ``codes`` has code and did, ``vectors`` did and embedding.  A code of more than
    ``slice_rows`` candidates is cut into slices.  Its slices lie at as many places, each
    with a key of its own and so in several buckets, as the code's share of the pool
    fills buckets; a code that fits one has one place, however many slices it has.
    ``block`` cuts a place into parts of about ``BLOCK_ROWS`` rows.  Re-ranking reads the
    buckets without moving the pool.
    """
    spark = codes.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = codes.select("code", "did").join(vectors.select("did", "embedding"), "did")
    held = codes.groupBy("code").agg(F.count(F.lit(1)).alias("held"))
    total = F.coalesce(codes.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    slices = F.ceil(F.col("held") / slice_rows).cast("int")
    many = held.withColumn("slices", slices).withColumn("places", F.least("slices", F.ceil(F.col("held") * n / total).cast("int")))
    many = many.withColumn("blocks", F.ceil(F.col("held") / F.col("places") / BLOCK_ROWS).cast("int"))
    # fewer than one row for each slice_rows or BLOCK_ROWS candidates
    many = many.where("slices > 1 OR blocks > 1").drop("held")
    rows = rows.join(F.broadcast(many), "code", "left")
    for c in ("slices", "places", "blocks"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(1)))
    cut = F.pmod(F.xxhash64("did"), F.col("slices")).cast("int").alias("slice")
    block = F.pmod(F.hash("did"), F.col("blocks")).alias("block")
    rows = rows.select("code", cut, "slices", "places", block, "did", "embedding")
    rows = rows.withColumn("key", code_place("code", F.pmod("slice", "places")))
    name = f"trovekit_{uuid.uuid4().hex}"
    # one file for each bucket
    rows = rows.repartition(n, "key")
    rows.write.mode("overwrite").bucketBy(n, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([(n, rows.schema.json())], "buckets int, schema string").coalesce(1).write.mode("overwrite").json(f"{path}.buckets")


def read_vectors_by_code(spark: SparkSession, path: str) -> DataFrame:
    """The vectors stored by ``write_vectors_by_code``: key, code, slice, slices, places, block, did, embedding."""
    stored = spark.read.schema("buckets int, schema string").json(f"{path}.buckets").first()
    schema = T.StructType.fromJson(json.loads(stored.schema))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"trovekit_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {stored.buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    out.schema  # the plan knows the files and the buckets from here on
    spark.sql(f"DROP TABLE {name}")
    return out


def code_place(code, place) -> Column:
    """Key of a place of a code."""
    c, s = (F.col(x) if isinstance(x, str) else x for x in (code, place))
    return F.concat_ws("/", code_to_tokens(c), s.cast("string"))


def keyed_vectors(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Query and pool vectors in one table, keys prefixed ``q_`` and ``p_``."""
    q = queries.withColumn("key", F.concat(F.lit("q_"), F.col("id").cast("string")))
    p = pool.withColumn("key", F.concat(F.lit("p_"), F.col("id").cast("string")))
    return q.drop("id").unionByName(p.drop("id"))


def aligned_pairs(queries: DataFrame, positives: DataFrame, position: str = "pos") -> DataFrame:
    """Row-aligned (query, positive) vectors, joined on an explicit position."""
    q = queries.select(position, F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    p = positives.select(position, F.col("id").alias("p_id"), F.col("embedding").alias("p_embedding"))
    return q.join(p, position)
