"""Session helpers: a local session for tests and reliable checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trovekit")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary
    folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="trovekit-")
    return _LOCAL_DIRS[context.applicationId]


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "trovekit", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path of this application below the shared folder."""
    return os.path.join(_scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a path through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything this application has written to the shared folder.

    Call it when the results that read from there have been written elsewhere.
    """
    remove_path(spark, _scratch_root(spark))


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative jobs; unlike an executor-local checkpoint the
    written files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialize_bucketed(df: DataFrame, key: str, label: str = "stage", buckets: int | None = None) -> DataFrame:
    """Like ``materialize``, stored in hash buckets of ``key``.

    Joins and groups by ``key`` read the buckets without a shuffle of this side.
    ``buckets`` is the number of shuffle partitions unless given.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = f"trovekit_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # the plan holds the files from here on; the name is not needed any more
    spark.sql(f"DROP TABLE {name}")
    out._scratch = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove the files behind frames that ``materialize`` returned and nothing reads any more."""
    for df in frames:
        if getattr(df, "_scratch", None):
            remove_path(df.sparkSession, df._scratch)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    For runs from a source tree; an installed package needs nothing.  Done once
    per application.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="trovekit-package-"), "trovekit")
    archive = shutil.make_archive(target, "zip", root_dir=root, base_dir="trovekit")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
