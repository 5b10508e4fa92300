"""Comparing all members of hash buckets without a task for a whole bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """``rows`` of buckets with two members or more, dealt to groups that together meet every pair once.

    A bucket is cut into blocks of about ``block`` members, and each pair of blocks
    (``_i <= _j``) is a group: members of different blocks ``_b`` meet there, and members of
    the same block where ``_i = _j``.  Rows come sorted by group within their partition.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(sizes, keys)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    rows = rows.withColumn("_blocks", blocks).drop("_n")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_other")).withColumn("_j", F.greatest("_b", "_other")).drop("_blocks", "_other")
    return rows.repartition(*keys, "_i", "_j").sortWithinPartitions(*keys, "_i", "_j", "_b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the row at which each group starts, from sorted batches."""
    held: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        if table.num_rows:
            new[0] = True
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        at = starts(held)
        if len(at) > 1:
            yield held.slice(0, int(at[-1])), at[:-1]
            held = held.slice(int(at[-1]))
    if held is not None and held.num_rows:
        yield held, starts(held)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that links ``a[i]-b[i]`` reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
