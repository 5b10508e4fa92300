"""Embedding near-duplicates by spherical-cap filters (operator 6).

A random product code gives the filters: space is rotated and cut into blocks, each with
its own random unit vectors, and a filter is one vector from each block.  A vector is
decoded to the list of all filters whose inner product with it exceeds a threshold.  The
threshold is the vector's own, so that it exceeds ``FIRES`` filters: with a common one,
some vectors exceed none and a third of the pairs at cosine 0.95 is missed.  Vectors that
share a filter are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.buckets import blocked, forest, whole_groups
from doclumen.llm.common import components, land

MIN_COSINE = 0.95
#: Blocks of a filter are 4; so many code vectors in each.
CODE = 24
#: Filters that a vector exceeds.  Of pairs at cosine 0.951, 99.6 % share one of 32.
FIRES = 40
BLOCK = 512
SEED = 11


class ProductCode:
    """The filters for vectors of one dimension; short vectors are padded before the rotation."""

    def __init__(self, dims: int, code: int = CODE, fires: int = FIRES, seed: int = SEED):
        rng = np.random.default_rng([seed, dims])
        width = max(64, -(-dims // 4) * 4)
        self.rotation = np.linalg.qr(rng.normal(size=(width, width)))[0][:dims]
        words = rng.normal(size=(4, code, width // 4))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True)
        self.half, self.fires = code * code, fires
        # A sum of the i-th and j-th largest of two lists is among the largest ``fires`` only
        # if (i + 1) * (j + 1) is at most that.
        i, j = np.indices((min(fires, self.half),) * 2)
        self.i, self.j = (x[(i + 1) * (j + 1) <= fires] for x in (i, j))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the filters that each vector exceeds, ascending, a row for each vector."""
        n, kept = len(unit), min(self.fires, self.half)
        blocks = (unit @ self.rotation).reshape(n, 4, -1)
        products = np.einsum("nbw,bcw->nbc", blocks, self.words)
        halves = []
        for k in (0, 2):
            sums = (products[:, k, :, None] + products[:, k + 1, None, :]).reshape(n, -1)
            order = np.argsort(-sums, axis=1, kind="stable")[:, :kept]
            halves.append((order, np.take_along_axis(sums, order, axis=1)))
        (front, f), (back, b) = halves
        best = np.argsort(-(f[:, self.i] + b[:, self.j]), axis=1, kind="stable")[:, : self.fires]
        found = np.take_along_axis(front[:, self.i] * self.half + back[:, self.j], best, axis=1)
        return np.sort(found, axis=1).astype("<i4")


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each vector and filter it exceeds."""
    codes: dict[int, ProductCode] = {}
    for batch in batches:
        nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vectors = batch.column(2)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy()
        at = np.cumsum(lengths) - lengths
        for dims in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dims)
            if dims not in codes:
                codes[dims] = ProductCode(dims)
            for part in np.array_split(rows, -(-len(rows) // 2048)):
                unit = _unit(flat[at[part][:, None] + np.arange(dims)])
                fired = codes[dims].decode(unit)
                whole = [pa.scalar(u.tobytes(), pa.binary()) for u in flat[at[part][:, None] + np.arange(dims)].astype("<f8" if flat.dtype == np.float64 else "<f4")]
                taken = np.repeat(np.arange(len(part)), fired.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fired.reshape(-1)),
                        pa.array(np.full(len(taken), dims, np.int32)),
                        pa.array(nodes[part][taken]),
                        pa.array(sizes[part][taken]),
                        pa.array(whole, pa.binary()).take(pa.array(taken)),
                        pa.array([f.tobytes() for f in fired], pa.binary()).take(pa.array(taken)),
                    ],
                    names=["filter", "dims", "node", "size", "vector", "filters"],
                )


def _earlier(fired: np.ndarray, a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
    """Whether pairs share a filter before ``own``: they are counted there."""
    rows, columns = np.nonzero(fired < own)
    filters, which, counts = np.unique(fired[rows, columns], return_inverse=True, return_counts=True)
    shared = counts[which] > 1
    place = np.cumsum(counts > 1) - 1
    table = np.zeros((len(fired), int((counts > 1).sum())), np.float32)
    table[rows[shared], place[which[shared]]] = 1
    return (table @ table.T)[a, b] > 0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each group the vectors at ``MIN_COSINE``: links of each node that are first met here, and a
    spanning forest (``node, root``) of all that are met."""
    for table, starts in whole_groups(batches, ["filter", "dims", "_i", "_j"]):
        nodes, sizes = table.column("node").to_numpy(), table.column("size").to_numpy()
        own, block = table.column("filter").to_numpy(), table.column("_b").to_numpy()
        cross = (table.column("_i").to_numpy() != table.column("_j").to_numpy())
        dims = table.column("dims").to_numpy()
        vectors, lists = table.column("vector"), table.column("filters")
        out_node, out_links, out_root = [], [], []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)]):
            if end - start < 2:
                continue
            raw = b"".join(v.as_py() for v in vectors.slice(start, end - start))
            wide = len(raw) // ((end - start) * int(dims[start]))
            unit = _unit(np.frombuffer(raw, dtype=f"<f{wide}").reshape(end - start, -1))
            near = np.triu(unit @ unit.T >= MIN_COSINE, 1)
            if cross[start]:
                near &= block[start:end, None] != block[None, start:end]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            fired = np.frombuffer(b"".join(f.as_py() for f in lists.slice(start, end - start)), dtype="<i4").reshape(end - start, -1)
            new = ~_earlier(fired, a, b, int(own[start]))
            n = np.zeros(end - start, np.int64)
            np.add.at(n, a[new], sizes[start:end][b[new]])
            np.add.at(n, b[new], sizes[start:end][a[new]])
            root = forest(a, b, end - start)
            told = np.flatnonzero((n > 0) | (root != np.arange(end - start)))
            out_node.append(nodes[start:end][told])
            out_links.append(n[told])
            out_root.append(nodes[start:end][root[told]])
        if out_node:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_links, out_root)], names=["node", "links", "root"])


def embedding_dedup(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing; vectors of different length do not link; equal vectors link and are compared
    once.  Missing ids are never the smallest unless a whole component's are missing (then
    ``kept`` is false).  An empty table gives an empty result; other columns are not read.
    """
    base = land(vectors.select(F.monotonically_increasing_id().alias("_uid"), "vec_id", "embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = base.filter(F.coalesce(usable, F.lit(False)))
    classes = land(good.groupBy("embedding").agg(F.min("_uid").alias("node"), F.count("*").alias("size")))
    schema = "filter int, dims int, node long, size long, vector binary, filters binary"
    rows = land(classes.select("node", "size", "embedding").repartition("node").mapInArrow(_filters, schema))
    met = land(
        blocked(rows, ["filter", "dims"], "node", BLOCK).mapInArrow(_compared, "node long, links long, root long"), release=True
    )
    linked = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    same = good.join(classes, "embedding").select("_uid", "node", "size")
    named = same.join(linked, "node", "left").join(found, "node", "left")
    named = named.select("_uid", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    every = base.select("_uid", "vec_id").join(named, "_uid", "left").withColumn("component", F.coalesce("component", "_uid"))
    every = land(every)
    least = land(every.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    out = every.join(least, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
