"""What the corpus operators share: scratch tables, hashing of rows, byte-bounded Arrow batches."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

ARROW_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` as a full URI, so that Spark and Arrow open the same place. Only a local session may go without."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
        base = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Scratch:
    """Tables written under the cluster's shared checkpoint folder.

    A written table cuts lineage and survives lost executors. ``drop`` frees a table that nothing needs any more;
    what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df``, written once and read again."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete these tables; without names, all of them."""
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None:
                return
            for name in names or ("",):
                path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as gone:  # the JVM may already have ended at exit
            if names:
                raise gone


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches that go to Python workers by rows and by bytes, if the session has not been bounded lower."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        try:
            now = int(spark.conf.get(key).lower().removesuffix("b"))
        except Exception:
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])


def bucket_count(spark: SparkSession, n: int, each: int) -> int:
    """Buckets of about ``each`` of ``n`` bytes or rows, at least as many as shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
