"""Arrow batches to Python workers, bounded so that a worker's memory does not grow with the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

# As many rows and bytes as the corpus operators allow; rows are at most 10,000 in a session that says nothing.
ROWS, BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches by rows and by bytes, if they have not been bounded lower. Plans read the limits when they run."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        try:
            now = int(spark.conf.get(key).lower().removesuffix("b"))
        except ValueError:
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
