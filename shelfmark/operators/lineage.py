"""Cutting the lineage of rows that a loop builds on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the folder that spark.checkpoint.dir names, which
    survives lost executors.  A local session without one gets a folder of its own."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there:
            if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            there = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
        sc.setCheckpointDir(there)
    return rows.checkpoint()
