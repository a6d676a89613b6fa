"""Bounds on what a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes that the JVM and a Python worker exchange at once.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded() -> None:
    """Cut batches by bytes too: 10,000 rows of long texts, and what a function makes of
    them, would else be in memory together.  A lower bound stays as it is."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not 0 < int(spark.conf.get(_BYTES).rstrip("bB") or 0) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
