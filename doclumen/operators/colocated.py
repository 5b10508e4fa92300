"""Documents landed in buckets, to be met there by patterns without moving again.

A large set of patterns cannot be broadcast, and sending the documents' texts to the
patterns for every search costs a shuffle of the corpus each time.  Documents are
therefore landed once in a bucketed table keyed by project and part.  A part is a share of
a project's documents by bytes, so that a project with a third of the corpus is many
parts.  A search sends each part the patterns that it is to be searched for and zips the
two sides bucket by bucket: only patterns are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclumen.runtime import broadcast_if_small, delete_at_exit, materialize, shared_folder

#: Bytes of text that one group of a search holds, and that a bucket has.
PART_BYTES = 32 << 20
BUCKET_BYTES = 128 << 20


@dataclass(frozen=True)
class ColocatedDocs:
    """``docs``: ``project, part, path, text`` in ``buckets`` by project and part; ``parts``:
    ``project, parts`` of the projects that have more than one."""

    docs: DataFrame
    parts: DataFrame
    buckets: int


def _part_counts(docs: DataFrame) -> DataFrame:
    sizes = docs.groupBy("project").agg(F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.ceil(F.col("bytes") / PART_BYTES).cast("int")
    return materialize(sizes.select("project", parts.alias("parts")).where(F.col("parts") > 1))


def colocate(docs: DataFrame) -> ColocatedDocs:
    """Land ``docs(project, path, text)`` for any number of searches.

    This is the one time that texts are shuffled.  Projects without a name go nowhere: no
    pattern can belong to them.
    """
    spark = docs.sparkSession
    docs = materialize(docs.select("project", "path", "text").where(F.col("project").isNotNull()))
    parts = _part_counts(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    placed = docs.join(broadcast_if_small(parts), "project", "left").select(
        "project",
        F.pmod(F.xxhash64("path"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
        "path",
        "text",
    )
    name = f"doclumen_docs_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    # Dealt out as the table's buckets are, every task writes the one file of its buckets.
    (
        placed.repartition(buckets, "project", "part")
        .write.format("parquet")
        .option("path", path)
        .option("compression", "zstd")
        .bucketBy(buckets, "project", "part")
        .saveAsTable(name)
    )
    delete_at_exit(spark, path)
    return ColocatedDocs(spark.table(name), parts, buckets)


def search(
    patterns: DataFrame,
    landed: ColocatedDocs,
    emit: Callable[[str, list[str], pa.Table], list[dict]],
    arrow: pa.Schema,
    schema: T.StructType,
) -> DataFrame:
    """``emit(project, patterns, documents)`` for every part that has patterns.

    ``patterns`` is ``project, part, pattern``: each part gets those that are sent to it, best those
    only that occur there.  They and the part's documents are in memory together.
    """
    sent = patterns.select("project", "part", "pattern").repartition(landed.buckets, "project", "part")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        project = left.column("project")[0].as_py()
        return pa.Table.from_pylist(emit(project, left.column("pattern").to_pylist(), right), schema=arrow)

    keys = ("project", "part")
    return sent.groupBy(*keys).cogroup(landed.docs.groupBy(*keys)).applyInArrow(meet, schema)
