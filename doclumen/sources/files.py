"""Project files as a table: ``project, path, content``.

At scale the corpus is a landed Parquet table (:func:`read_table`).
:func:`scan_trees` reads project directories on a shared file system
(:mod:`doclumen.sources.trees`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclumen.runtime import materialize
from doclumen.sources import trees

#: Roots whose partitions are planned together on the driver.
PLANNED_ROOTS = 100_000


def normalize_newlines(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n?", "\n")


def clean(files: DataFrame) -> DataFrame:
    """Text files as readers see them: bad UTF-8 dropped, newlines unified."""
    if dict(files.dtypes)["content"] == "binary":
        files = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    return files.select(
        "project", "path", normalize_newlines(F.col("content").cast("string")).alias("content")
    )


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed ``project, path, content`` table; content is string or binary."""
    return clean(spark.read.format(fmt).load(path).select("project", "path", "content"))


def scan_trees(roots: DataFrame) -> DataFrame:
    """Read every text file below ``roots(project, root)``.

    A pass over the roots counts what each holds, far enough to tell large ones; the data
    source then plans them, some at a time so that the driver holds no more.
    """
    spark = roots.sparkSession
    trees.register(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([trees.count_entries(r.as_py()) for r in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=["project", "root", "entries"])

    spread = roots.select("project", "root").where(F.col("root").isNotNull()).repartition(F.xxhash64("project", "root"))
    counted = materialize(spread.mapInArrow(count, "project string, root string, entries long"))
    total = counted.count()
    slices = -(-total // PLANNED_ROOTS)
    reads = []
    for number in range(slices):
        mine = counted.where(F.pmod(F.xxhash64("root", "project"), F.lit(slices)) == number)
        listed = json.dumps([list(row) for row in mine.collect()])
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        reads.append(spark.read.format("project_files").option("roots", listed).option("partitions", str(tasks)).load())
    if not reads:
        return clean(spark.createDataFrame([], "project string, path string, content binary"))
    return clean(reduce(DataFrame.unionByName, reads))
