"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_folders: set[str] = set()
_shipped: set[str] = set()


def local_session(cores: int = 8, app: str = "lakelens", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only on a single machine (tests) is a folder of our own set where none is named; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lakelens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _stage_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"
    local = folder.removeprefix("file://")
    if folder not in _folders and local.startswith("/"):
        _folders.add(folder)
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return folder


def stage_table(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder, partitioned by the columns ``by``, and read it back.

    The files outlive any executor, so a lost executor costs a re-read, not a recomputation. They lie in one folder per
    application, which goes when the driver ends (:func:`drop_stages` removes it earlier, and on other file systems).
    """
    path = f"{_stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.partitionBy(*by).mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Remove all staged tables of this application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(table: DataFrame) -> DataFrame:
    """Rows of a small table over more partitions, for stages that compute much per row.

    Eight times the scan's partitions at most, and no more than the session has cores; a table of enough partitions is
    left as it is. ``table`` must be a plain scan: its partitions are counted without running anything.
    """
    cores, parts = table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()
    return table.repartition(min(cores, 8 * parts)) if 0 < parts < cores else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on all executors, once per application, wherever the driver found it."""
    application, source = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if application in _shipped or not source.is_dir():
        return
    _shipped.add(application)
    shared = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    # the driver serves the archive to executors as they start, so it lies apart from the stages and stays to the end
    folder = Path(shared) / f"package-{application}" if shared.startswith("/") else Path(tempfile.mkdtemp(prefix="lakelens-"))
    folder.mkdir(parents=True, exist_ok=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(archive := folder / "lakelens.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(source.rglob("*.py")):
            z.write(path, path.relative_to(source.parent))
    spark.sparkContext.addPyFile(str(archive))
