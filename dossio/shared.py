"""The folder that driver and executors share, for what a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names.  Where it names nothing, a temporary folder in local mode, and an error on a cluster.

    A folder of one machine would be written in silence where the others can't read.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="dossio-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as compressed Parquet in the shared folder, read again: no later step works them out anew."""
    spark = df.sparkSession
    spark._jvm.System.gc()  # shuffle files of the steps before stay until the driver happens to collect its garbage
    df.write.option("compression", "zstd").parquet(to := f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(to)


def remove(*frames: DataFrame) -> None:
    """Deletes the files of ``written`` frames that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
