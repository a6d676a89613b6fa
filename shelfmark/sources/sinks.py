"""Writers: listings as CSV, and tables replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats


def write_csv(rows: DataFrame, folder: str) -> None:
    """Lines with CRLF ends, quoted by formats.csv_field; a header is the first column
    names' own line in every file."""
    line = formats.csv_line(*[F.col(c).cast("string") for c in rows.columns]).alias("value")
    rows.select(line).write.mode("overwrite").option("lineSep", "\r\n").text(folder)


def replace_table(rows: DataFrame, folder: str) -> None:
    """Write beside the table, then swap by two renames.  A failed write leaves the old
    rows; a failed swap brings them back and raises.  Between the renames there is no
    table, so readers should not start meanwhile."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    table, staged, old = (path(folder + end) for end in ("", f".staged-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    rows.write.parquet(staged.toString())
    fs = staged.getFileSystem(conf)
    had = fs.exists(table)
    if had and not fs.rename(table, old):
        fs.delete(staged, True)
        raise OSError(f"{folder} can't be moved aside")
    if not fs.rename(staged, table):
        if had:
            fs.rename(old, table)
        fs.delete(staged, True)
        raise OSError(f"{folder} can't be replaced")
    if had:
        fs.delete(old, True)
