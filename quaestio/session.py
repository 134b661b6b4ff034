"""Session helpers: reading tables, the shared folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, wherever they run and whatever their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="quaestio-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))  # served by the driver to every executor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a file or a folder of Parquet parts."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the executors are threads of this process, as in tests, may it be unset: a folder of this
    machine is set then. On a cluster that would lose rows, so it is an error.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quaestio-"))
    return jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through files in the shared folder, which outlive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame) -> DataFrame:
    """Like ``checkpoint``, as a compressed columnar table: later reads prune columns and have sizes.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Split a small input over all cores ahead of CPU-heavy work.

    For scans and what is projected from them only: to count the partitions of a plan with a shuffle
    would run it. A scan of many partitions is left as it is, so large inputs aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= per_core * cores:
        return df
    return df.repartition(per_core * cores)
