"""Readers of the Parquet tables and the places where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; filters and column choices reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``, else the context's checkpoint folder; only where both are unset and the
    master is this machine, as in tests, a folder of this machine is made and set. On a cluster that is an error, as
    executors would write where no other can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if (spark.sparkContext.master or "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="watchbill-")
        spark.sparkContext.setCheckpointDir(root)
    return root


_owned: set[str] = set()  # folders of this session, removed when it ends


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session is over; what is left is the shared folder's owner's to remove
        pass


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when the driver ends, as results read from it until then."""
    path = f"{shared_dir(spark)}/watchbill-{spark.sparkContext.applicationId}"
    if path not in _owned:
        _owned.add(path)
        atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = f"{session_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def busy_parts(spark: SparkSession) -> int:
    """Partitions that keep all cores busy with Python work that costs far more than moving its input, whatever AQE makes
    of its size."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
