"""Two physical decisions that Catalyst cannot make: materialising and size checks."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and most characters (as JSON) of a side that is offered for broadcasting.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 64_000_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/doclumen-intermediate"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, for plans that read it more than once.

    It is written as Parquet in the shared folder and read back: readers take only the
    columns they need and push their filters to the scan, lost executors cost nothing
    that was written, and the lineage ends.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files that no table needs any more; Spark does it only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after measuring; larger inputs join by shuffle.

    Rows may hold texts or arrays of any length, so their size is summed as well as
    counted, over no more rows than could be broadcast.  ``df`` must be cheap to read
    again: pass a materialised table.
    """
    chars = F.sum(F.length(F.to_json(F.struct(*df.columns))))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), chars).first()
    if rows <= max_rows and (size or 0) <= BROADCAST_CHARS:
        return F.broadcast(df)
    return df
