"""Tables that are computed once: partition numbers and other chance must not change when a lost executor's part is made again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the whole cluster shares, as a full URI: that in ``spark.checkpoint.dir``. Only a local session may go without."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(base or f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    path = sc._jvm.org.apache.hadoop.fs.Path(base or sc.getCheckpointDir())
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer splits than there are cores; larger inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
