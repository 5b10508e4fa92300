"""Labelled samples, and scoring passes over whole texts, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on; they are the first in the order of a hash.
LABELLED_ROWS = 20_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from; a missing id has no label and is not one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``_of, label``: ids outside the held-out fold with one label, 0 or 1; nulls and contradictions do not count."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").alias("_of")).agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return one.filter("label = _most").drop("_most")


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``_of, text, label`` for each id of ``chosen(_of, label)`` that documents have, with the least of its texts."""
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_of"))
    return found.groupBy("_of").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """``text, label`` (0 or 1) of at most ``rows`` labelled documents outside the held-out fold.

    Labels that are null or contradict each other do not count.  The chosen ids are
    bounded by ``rows`` and so may be broadcast; an id that documents repeat counts once,
    with the least of its texts.
    """
    chosen = known_labels(labels, label).orderBy(F.xxhash64("_of"), "_of").limit(rows)
    return labelled_texts(docs, F.broadcast(chosen)).select("text", "label")


def featured(docs: DataFrame, features: Callable[[str], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, on the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "label"])

    found = docs.mapInArrow(measured, "x array<double>, label int").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64)
    # A fixed order, whatever tasks ended first.
    order = np.lexsort((*x.T, found["label"].to_numpy())) if len(x) else np.arange(0)
    return x[order], found["label"].to_numpy(np.int64)[order]


def scored(docs: DataFrame, features: Callable[[str], list[float]], model: Callable[[np.ndarray], np.ndarray], cut: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; null texts count as empty."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.empty(0)
            if batch.num_rows:
                score = model(np.array([features(t.as_py() or "") for t in batch.column(1)], dtype=np.float64))
            arrays = [batch.column(0), pa.array(score), pa.array((score >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
