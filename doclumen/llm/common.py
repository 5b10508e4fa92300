"""Helpers that several operators share: landed tables, components, word splitting."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are missing come after all others wherever documents are ordered.
LAST_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one in the warehouse where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/doclumen-intermediate"
    return folder.rstrip("/")


#: Rows that a Python worker gets at once; texts are some kilobytes each.
BATCH_ROWS = 2000


def land(df: DataFrame, release: bool = False, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A landed table outlives lost executors and cuts the lineage.  With ``release`` the
    shuffle files of the jobs behind it are let go at once, so that disk holds one step's
    shuffles at a time; Spark removes them only when the driver collects its garbage.
    Python workers get small batches while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/doclumen-{uuid.uuid4().hex}"
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(size, before)
    schema = df.schema
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._landed_at = path
    return out


def drop(landed: DataFrame) -> None:
    """Delete a landed table that nothing reads any more."""
    spark = landed.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landed._landed_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def plain(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_order(column: Column | str) -> Column:
    """Orders ids, missing ones last."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LAST_ID))


def words(text: Column) -> Column:
    """Maximal runs of anything but space, tab, line feed, vertical tab, form feed, return."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-rows // per_partition))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``(node, component)`` for every node of ``edges(a, b)``.

    Large-star and small-star steps: each points the neighbours of a node at the
    smallest of them, so that edges end as stars around the smallest node of their
    component.  Everything is a grouped minimum and an equi-join with it.  The minima are
    landed, so that the join alone deals out a node with a third of all edges and
    adaptive execution can split it.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large_star(df: DataFrame) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(df.select("b", "a"))
        least = land(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(df: DataFrame) -> DataFrame:
        least = land(df.groupBy("a").agg(F.min("b").alias("m")))
        return df.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))

    now = land(pairs(edges))
    before = None
    for _ in range(max_rounds):
        after = land(pairs(small_star(land(pairs(large_star(now))))))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.union(now.select("b", "b").distinct())
