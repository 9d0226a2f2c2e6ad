"""Session helpers: tested settings, the shared scratch folder, staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "flowlens", shuffle: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    n = shuffle or (cpus if isinstance(cpus, int) else 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JVM interprets methods over 8,000 bytes; wide projections then run as compiled parts instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def compile_wide(spark: SparkSession) -> None:
    """Have generated methods that the JVM would only interpret cut into compiled parts, also in a session of others."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


_TEST_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a local master (tests) is a temporary folder
    made, once per application.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _TEST_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="flowlens-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage at points whose result is read several times: a lost
    executor re-reads the table and column pruning keeps working.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers then find it from any working folder, installed there or not.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-code-"), "flowlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("flowlens", os.path.relpath(full, root)))
    context.addPyFile(path)
