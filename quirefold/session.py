"""Session settings, table access and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quirefold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per context; they need not share its folder."""
    context = spark.sparkContext
    if getattr(context, "_quirefold_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quirefold-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/quirefold.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(f"{folder}/quirefold.zip")
    context._quirefold_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table that lies in fewer splits than there are cores, hashed by key over the cores, for
    work in Python that costs far more than the move. A table in many splits is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`). Only where it is unset, as in
    tests on one machine, a temporary folder takes its place."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[str] = []
_cleared: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder is named after the application and can be removed by hand
        pass


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder, below the application's own folder, which is removed
    when the driver ends, or below that of the innermost open workspace()."""
    root = f"{shared_dir(spark)}/quirefold/{spark.sparkContext.applicationId}"
    if root not in _cleared:
        _cleared.add(root)
        atexit.register(_delete, spark, root)
    return f"{_scopes[-1] if _scopes else root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside are removed at the end: read or write the results before it closes."""
    path = work_path(spark, "workspace")
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        _delete(spark, path)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: the lineage ends there, so a lost
    executor costs a read and not the work before it, and later branches share one computation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
