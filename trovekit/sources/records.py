"""JSON-lines and JSON records, and key columns over pools and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovekit.functions.text import doc_key
from trovekit.operators.pools import ensure_unique


def file_position():
    """Sortable position of a row of a text-based file scan.

    Rows of one input block are read in order by one task, so (file, block,
    running id) reproduces the order of the lines whatever the partitioning.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def source_name(root: str, depth: int):
    """Name below ``root`` of the file a row was scanned from, cut to its first ``depth`` parts.

    A name that is a folder of part files stands for all of them.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # the scan may spell the scheme of the root in another way
    mark = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    below = F.substr(path, F.instr(path, mark) + F.lit(len(mark)))
    return F.substring_index(below, "/", depth)


def read_jsonl(spark: SparkSession, path, schema: T.StructType, position: str | None = None) -> DataFrame:
    """Scan JSON lines; ``position`` names an optional order column."""
    df = spark.read.schema(schema).json(path)
    if position is None:
        return df
    return df.select(*[F.col(f.name) for f in schema.fields], file_position().alias(position))


def read_entries(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines or one JSON array, told apart by the file extension."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raise ValueError("only .json and .jsonl files can be read")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write JSON lines; ``mode`` is ``overwrite`` or ``append``."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def keyed_pool(pool: DataFrame, key_type: str = "content", check: bool = True) -> DataFrame:
    """Pool with a unique ``key`` column: the content key or the id."""
    if key_type == "content":
        keyed = pool.withColumn("key", doc_key())
    elif key_type == "did":
        keyed = pool.withColumn("key", F.col("did"))
    else:
        raise ValueError(f"unknown key type {key_type!r}")
    return ensure_unique(keyed, "key") if check else keyed


def keyed_queries(queries: DataFrame, key_type: str = "qid", check: bool = True) -> DataFrame:
    """Queries with a unique ``key`` column: the id or the content key."""
    if key_type == "qid":
        keyed = queries.withColumn("key", F.col("qid"))
    elif key_type == "content":
        keyed = queries.withColumn("key", doc_key("query_txt", "query_img_path", "query_modality"))
    else:
        raise ValueError(f"unknown key type {key_type!r}")
    return ensure_unique(keyed, "key") if check else keyed


def by_source_field(pool: DataFrame, field: str, order, keep: str = "last") -> DataFrame:
    """Pool rows addressed by a field of their source content.

    ``last`` keeps the last row per value (``key`` and the pool columns);
    ``all`` keeps every row, so a frequent value stays spread over many rows.
    """
    keyed = pool.withColumn("key", F.get_json_object("src_content", f"$.{field}")).where(F.col("key").isNotNull())
    if keep == "all":
        return keyed
    latest = keyed.groupBy("key").agg(F.max_by(F.struct(*pool.columns), order).alias("row"))
    return latest.select("key", "row.*")
