"""Delimited tables and JSON objects that hold rows as map entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = "img_path string, score double, description string"
BASE64_IMAGES = "image_id string, payload string"


def read_csv(spark: SparkSession, path, schema) -> DataFrame:
    """Comma-separated file with a header line."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_labels(spark: SparkSession, path) -> DataFrame:
    """Folder of three-column label files; the middle column is not used."""
    rows = spark.read.schema(LABELS).option("sep", "\t").option("quote", "").csv(path)
    return rows.select("img_path", "description")


def read_base64_images(spark: SparkSession, path) -> DataFrame:
    """``id <tab> base64`` lines as (image_id, binary content)."""
    rows = spark.read.schema(BASE64_IMAGES).option("sep", "\t").option("quote", "").csv(path)
    return rows.select("image_id", F.unbase64("payload").alias("content"))


def parse_prompts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Instruction lines: query and candidate modality, dataset id, prompts.

    Column 2 is not used; the prompt columns are ragged and blanks are dropped.
    """
    parts = F.split(F.regexp_replace(F.col(value), r"^\s+|\s+$", ""), "\t")
    return lines.select(
        F.get(parts, F.lit(3)).alias("dataset_id"),
        parts[0].alias("query_modality"),
        F.get(parts, F.lit(1)).alias("cand_modality"),
        F.filter(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), lambda p: p != "").alias("prompts"),
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Instruction table of a ``.tsv`` file with a header line."""
    if not path.endswith(".tsv"):
        raise ValueError("instructions are read from .tsv files")
    rows = spark.read.option("sep", "\x01").option("quote", "").option("header", True).schema("value string").csv(path)
    return parse_prompts(rows)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated results with a header line in every part file."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "").csv(path)


def read_object_rows(spark: SparkSession, path, value_type: T.DataType | str) -> DataFrame:
    """Files that hold one JSON object each, as rows (key, value).

    The format makes a file the unit of parsing; many files parse in parallel.
    """
    text = spark.read.text(path, wholetext=True)
    return object_rows(text, value_type)


def object_rows(df: DataFrame, value_type: T.DataType | str, column: str = "value") -> DataFrame:
    kind = value_type if isinstance(value_type, str) else value_type.simpleString()
    return df.select(F.explode(F.from_json(column, f"map<string,{kind}>")).alias("key", "value"))


def read_split_map(spark: SparkSession, path, prefix: str) -> DataFrame:
    """Split files that map an image name to a relative path."""
    from trovekit.functions.text import drop_dot_dir, under

    rows = read_object_rows(spark, path, "string")
    return rows.select(F.col("key").alias("image_id"), under(prefix, drop_dot_dir("value")).alias("img_path"))
