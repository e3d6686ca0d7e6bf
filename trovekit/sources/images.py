"""Image listings and the check for readable JPEG files.

Only signatures are checked; pixels are never decoded.  Where the tasks can open the
files themselves they read three bytes of each; in stores that only Spark reaches
files are read whole through Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_images(spark: SparkSession, folder: str, extensions=("jpg", "jpeg", "png")) -> DataFrame:
    """Paths of the images below a folder; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(folder)
    )
    return files.select("path")


def is_jpeg(content="content"):
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(F.hex(F.substring(c, 1, 3)), 1, 6) == "FFD8FF"


#: schemes that tasks open themselves, by the scheme the file library knows
OPENED = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}
SIGNATURE = b"\xff\xd8\xff"


def image_manifest(spark: SparkSession, folder: str, opened: dict[str, str] | None = None) -> DataFrame:
    """(img_path, valid) for every file below a folder that holds any bytes, path relative to it.

    ``opened`` names the schemes of paths whose files the tasks open (default:
    ``OPENED``); files of others come whole through Spark.  The listing is Spark's.
    """
    opened = OPENED if opened is None else opened
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # the scan may spell the scheme in another way
    marker = "/" + folder.split("://")[-1].removeprefix("file:").strip("/") + "/"
    relative = F.substring_index(F.col("path"), marker, -1).alias("img_path")
    # the scheme the store's own listing gives its paths
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().getScheme()
    if scheme not in opened:
        return files.select(relative, is_jpeg().alias("valid"))
    known = opened[scheme]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, LocalFileSystem

        store = LocalFileSystem() if known == "file" else None
        for batch in batches:
            found = []
            for path in batch.column(1).to_pylist():
                inside = path.split(":", 1)[1]
                if store is None:
                    store = FileSystem.from_uri(f"{known}:{inside}")[0]
                inside = "/" + inside.lstrip("/") if known == "file" else inside.lstrip("/")
                with store.open_input_file(inside) as f:
                    found.append(f.read(len(SIGNATURE)) == SIGNATURE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], ["img_path", "valid"])

    # paths are many to a listed partition and cost a round trip each, so they are dealt anew
    paths = files.select(relative, "path").repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return paths.mapInArrow(run, "img_path string, valid boolean")


def valid_images(manifest: DataFrame) -> DataFrame:
    return manifest.where("valid").select("img_path")


def with_valid_image(df: DataFrame, manifest: DataFrame, column: str = "img_path") -> DataFrame:
    """Rows whose image is readable (semi join)."""
    valid = valid_images(manifest).withColumnRenamed("img_path", column)
    return df.join(valid, column, "left_semi").select(df.columns)


def demote_invalid_image(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keep rows with an unreadable image as text rows without a path."""
    valid = manifest.where("valid").groupBy("img_path").agg(F.lit(True).alias("__ok"))
    joined = df.join(valid, "img_path", "left")
    return joined.withColumn(
        "modality", F.when(F.col("img_path").isNotNull() & F.col("__ok"), F.lit("image,text")).otherwise(F.lit("text"))
    ).withColumn("img_path", F.when(F.col("__ok"), F.col("img_path"))).select(df.columns)
