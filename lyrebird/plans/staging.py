"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one is made and set if all of Spark runs on this
    machine, as in tests; on a cluster that would be a folder which others can't read, so that raises RuntimeError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="lyrebird-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _written.append((spark, folder))
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_folder(spark)}/lyrebird/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: the plan starts anew at the files, which
    survive the loss of executors. ``by`` sorts rows inside each file. The folder is removed when the program ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.sortWithinPartitions(*by) if by else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes what ``staged`` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already
            return


atexit.register(release)
