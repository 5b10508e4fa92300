"""SimHash near-duplicates by covering locality-sensitive hashing (operator 2).

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits.  A random vector of
RADIUS + 1 bits is drawn for each bit place; for each of the 2 ** (RADIUS + 1) - 1 nonzero
vectors v, the mask of table v has the places whose vector has an odd inner product
with v.  Up to RADIUS differing places span too little to meet every v, so two linked
fingerprints agree under at least one mask: no link is missed.

``deduplicated`` does not use these constants.  It links texts whose sets of
``DEDUP_SHINGLE`` words have a Jaccard similarity of ``DEDUP_SIMILARITY`` or more: covering
masks for radius ``PART_RADIUS`` on each of the ``PARTS`` parts of a longer fingerprint find
candidates, and only compared sets link.  Masks miss some of the pairs near the limit, of short texts above all.  An
exact step finds these: in any order of all shingles, two similar sets share one of their first
fifth (a prefix filter).  Only prefixes that meet across the groups already found are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.buckets import blocked, forest, whole_groups
from doclumen.llm.common import components, land, plain

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Members of a block of a bucket, and shingles that are unpacked to bits at once.
BLOCK = 1024
UNPACKED = 16_384

DEDUP_SHINGLE = 5
DEDUP_SIMILARITY = 0.8
#: Sets at similarity 0.8 differ in 15 % of the places, so one of the masks of a part agrees in
#: 18 % of the parts, and in at least one part for 99 % of such pairs.
PARTS = 24
PART_BITS = 24
PART_RADIUS = 1
#: A candidate differs in so many of the first 128 places at most: 20 are expected at 0.8, with a deviation of 4.
CHECK_RADIUS = 34
#: Pairs of a bucket that are held before they are made a forest.
FOREST_PAIRS = 200_000
#: Counters of shingles, whose order is by how frequent theirs is; only the work depends on it.  A page of them is summed at once.
COUNTERS = 1 << 22
COUNTER_PAGE = 1 << 16
#: Bits of the parities of a set, which differ in no more places than the sets do.
PARITY_BITS = 1024
#: Sets of a block that are compared at once.
SET_BLOCK = 256
SET_ROWS = 200


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The covering masks, each with about half of the 64 bits, as unsigned numbers."""
    vectors = np.random.default_rng(seed).integers(0, 2 ** (radius + 1), 64)
    return [sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text over its word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest as digest

    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, UNPACKED):
        part = found[at : min(at + UNPACKED, n) + SHINGLE - 1]
        if len(part) < SHINGLE:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            hashes = [digest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row of ``docs``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"") for t in batch.column(1)]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each group: rows of a group are compared at growing distance."""
    for table, starts in whole_groups(batches, ["t", "v", "_i", "_j"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        block = table.column("_b").to_numpy()
        cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        ends = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
        at = np.arange(len(fp))
        a, b, held, step = [], [], 0, 1
        root = at
        while len(at := at[at + step < ends[at]]):
            other = at + step
            near = np.bitwise_count(fp[at] ^ fp[other]) <= RADIUS
            near &= ~cross[at] | (block[at] != block[other])
            a.append(at[near])
            b.append(other[near])
            held += int(near.sum())
            if held > 1_000_000:
                a, b = [np.concatenate([*a, np.arange(len(fp))])], [np.concatenate([*b, root])]
                root = forest(a[0], b[0], len(fp))
                a, b, held = [], [], 0
            step += 1
        a, b = np.concatenate([*a, np.arange(len(fp))]), np.concatenate([*b, root])
        root = forest(a, b, len(fp))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        signed = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """``a, b`` over distinct fingerprints ``fp``: enough links to connect all that are linked."""
    tables = F.array(
        *(
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("v"))
            for t, m in enumerate(masks())
        )
    )
    rows = distinct.select("fp", F.inline(tables))
    return blocked(rows, ["t", "v"], "fp", BLOCK).mapInArrow(_linked, "a long, b long")


def simhash(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach.  Null and empty texts have
    fingerprint zero and link like any other; missing ids are never the smallest unless
    all of a component are missing; repeated rows share a component; an empty table gives
    an empty result.  Columns but ``doc_id`` and ``text`` are not read.
    """
    marked = land(fingerprints(docs))
    distinct = land(marked.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    found = components(land(links(distinct.select("fp")), release=True))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    roots = land(roots.withColumn("component", F.coalesce("component", "fp")))
    least = land(roots.groupBy("component").agg(F.min("_least").alias("component_id")))
    named = land(roots.join(least, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``DEDUP_SHINGLE`` words; a shorter text is one run, one without words has none."""
    from xxhash import xxh64_intdigest as digest

    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < DEDUP_SHINGLE:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    runs = zip(*(found[k:] for k in range(DEDUP_SHINGLE)))
    return np.unique(np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, len(found) - DEDUP_SHINGLE + 1))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``PARTS * PART_BITS`` bits over a set of hashes, as bytes."""
    n = PARTS * PART_BITS // 64
    turns = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), UNPACKED):
        mixed = hashes[at : at + UNPACKED, None] + turns
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((mixed ^ (mixed >> np.uint64(31))).view(np.uint8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes))


def part_keys(fps: np.ndarray) -> np.ndarray:
    """For rows of fingerprint bytes one key for each part and covering mask; equal keys are of the same part and mask.

    A part's places are dealt evenly to the nonzero vectors, so that a mask has two thirds of them.
    """
    vectors = np.arange(PART_BITS) % (2 ** (PART_RADIUS + 1) - 1) + 1
    bits = np.unpackbits(fps, axis=1).reshape(len(fps), PARTS, PART_BITS).astype(np.int64)
    keys = []
    for v in range(1, 2 ** (PART_RADIUS + 1)):
        places = [i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2]
        keys.append(bits[:, :, places] @ (1 << np.arange(len(places))) + (np.arange(PARTS) * 2 ** (PART_RADIUS + 1) + v << PART_BITS))
    return np.concatenate(keys, axis=1)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest as digest

    for batch in batches:
        sets = [shingle_set(t.as_py() or b"") for t in batch.column("body")]
        keys = pa.array([digest(s.tobytes()) for s in sets], pa.binary())
        fps = pa.array([long_fingerprint(s).tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("_id"), keys, fps], names=["_uid", "_id", "_key", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of each fingerprint, with its first 128 bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        keys = part_keys(fps)
        check = np.ascontiguousarray(fps[:, :16]).view(np.int64)
        each = np.repeat(np.arange(len(fps)), keys.shape[1])
        node = batch.column("node").to_numpy()
        arrays = [keys.ravel(), node[each], check[each, 0], check[each, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["k", "node", "c0", "c1"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidate pairs in each group, like ``_linked``."""
    for table, starts in whole_groups(batches, ["k", "_i", "_j"]):
        node = table.column("node").to_numpy()
        c0, c1 = (table.column(c).to_numpy().view(np.uint64) for c in ("c0", "c1"))
        block = table.column("_b").to_numpy()
        cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        n = len(node)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        at = np.arange(n)
        a, b, held, step = [], [], 0, 1
        root = at
        while len(at := at[at + step < ends[at]]):
            other = at + step
            near = np.bitwise_count(c0[at] ^ c0[other]).astype(np.int16) + np.bitwise_count(c1[at] ^ c1[other]) <= CHECK_RADIUS
            near &= ~cross[at] | (block[at] != block[other])
            a.append(at[near])
            b.append(other[near])
            held += int(near.sum())
            if held > FOREST_PAIRS:
                root = forest(np.concatenate([*a, np.arange(n)]), np.concatenate([*b, root]), n)
                a, b, held = [], [], 0
            step += 1
        root = forest(np.concatenate([*a, np.arange(n)]), np.concatenate([*b, root]), n)
        moved = np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have ``DEDUP_SIMILARITY`` or more."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or len(small) < DEDUP_SIMILARITY * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= DEDUP_SIMILARITY * (len(x) + len(y) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs in each group whose sets are similar."""
    for table, starts in whole_groups(batches, ["component", "_i", "_j"]):
        node, block = (table.column(c).to_numpy() for c in ("node", "_b"))
        c0, c1 = (table.column(c).to_numpy().view(np.uint64) for c in ("c0", "c1"))
        cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        a, b = [], []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("hashes").slice(start, end - start)]
            size = np.array([len(s) for s in sets])
            here, d0, d1 = block[start:end], c0[start:end], c1[start:end]
            root = np.arange(end - start)
            for i in range(end - start - 1):
                rest = slice(i + 1, None)
                near = np.bitwise_count(d0[i] ^ d0[rest]).astype(np.int16) + np.bitwise_count(d1[i] ^ d1[rest]) <= CHECK_RADIUS
                near &= np.minimum(size[i], size[rest]) >= DEDUP_SIMILARITY * np.maximum(size[i], size[rest])
                if cross[start]:
                    near &= here[i] != here[rest]
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    if root[i] != root[j] and _similar(sets[i], sets[j]):
                        root[root == root[j]] = root[i]
                        a.append(node[start + i])
                        b.append(node[start + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = pa.array([shingle_set(t.as_py() or b"").tobytes() for t in batch.column("body")], pa.binary())
        fps = batch.column("fp").to_pylist()
        check = np.frombuffer(b"".join(f[:16] for f in fps), np.int64).reshape(-1, 2)
        arrays = [batch.column("component"), batch.column("node"), pa.array(check[:, 0]), pa.array(check[:, 1]), hashes]
        yield pa.RecordBatch.from_arrays(arrays, names=["component", "node", "c0", "c1", "hashes"])


def similar_sets(sets: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b`` over ``sets(node, fp)``: enough links to connect all similar sets that the masks find.

    ``bodies(_uid, body)`` has the text of each node.  What candidates connect is compared
    set by set, so that a set goes to a few groups and not to one for each key.
    """
    rows = sets.select("node", "fp").mapInArrow(_keyed, "k long, node long, c0 long, c1 long")
    hot = land(rows.groupBy("k").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK), release=True)
    rows = rows.join(hot, "k", "left")
    rows = rows.withColumn("_blocks", F.coalesce(F.ceil(F.col("_n") / BLOCK), F.lit(1)).cast("int")).drop("_n")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_other")).withColumn("_j", F.greatest("_b", "_other")).drop("_blocks", "_other")
    rows = rows.repartition("k", "_i", "_j").sortWithinPartitions("k", "_i", "_j", "_b")
    candidates = components(land(rows.mapInArrow(_candidates, "a long, b long").distinct(), release=True))
    found = land(sets.join(candidates, sets["node"] == candidates["node"]).select("component", sets["node"], "fp"))
    found = found.join(bodies, F.col("node") == F.col("_uid")).select("component", "node", "fp", "body")
    found = land(found.mapInArrow(_sets, "component long, node long, c0 long, c1 long, hashes binary"), batch_rows=SET_ROWS)
    pairs = blocked(found, ["component"], "node", SET_BLOCK).mapInArrow(_compared, "a long, b long")
    return land(pairs, release=True, batch_rows=SET_ROWS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each counter occur in a task's sets, by page."""
    counts = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for text in batch.column("body"):
            np.add.at(counts, shingle_set(text.as_py() or b"") % np.uint64(COUNTERS), np.uint32(1))
    for page, part in enumerate(counts.reshape(-1, min(COUNTER_PAGE, COUNTERS))):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["page", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in table.column("counts"))
    levels = np.round(4 * np.log2(total + 1)).astype(np.uint8)
    return pa.table({"page": table.column("page")[:1], "levels": pa.array([levels.tobytes()], pa.binary())})


def frequency_levels(bodies: DataFrame) -> np.ndarray:
    """For each counter a level that grows with how many sets have its shingles."""
    few = bodies.coalesce(bodies.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(_counted, "page int, counts binary").groupBy("page").applyInArrow(_summed, "page int, levels binary")
    levels = np.zeros(COUNTERS, np.uint8)
    size = min(COUNTER_PAGE, COUNTERS)
    for row in found.toLocalIterator():  # 4 MB in all
        levels[row["page"] * size : (row["page"] + 1) * size] = np.frombuffer(row["levels"], np.uint8)
    return levels


def prefix(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the order of levels: sets with ``DEDUP_SIMILARITY`` or more share one of theirs."""
    if not len(hashes):
        return hashes
    least = int(np.ceil(DEDUP_SIMILARITY * len(hashes) - 1e-6))
    return hashes[np.lexsort((hashes, levels[hashes % np.uint64(COUNTERS)]))[: len(hashes) - least + 1]]


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``PARITY_BITS`` places whether an odd number of hashes fall on it."""
    places = hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return np.packbits(np.bincount((places % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def _prefixed(levels):
    """A row for each hash of each set's prefix; the first of a set has its parities."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(body.as_py() or b"") for body in batch.column("body")]
            found = [prefix(x, levels.value) for x in sets]
            each = np.repeat(np.arange(len(sets)), [len(x) for x in found])
            if not len(each):
                continue
            first = np.diff(each, prepend=-1) > 0
            bits = [parities(sets[i]) if new else None for i, new in zip(each.tolist(), first.tolist())]
            size = np.array([len(x) for x in sets], np.int32)
            node, component = (batch.column(c).to_numpy() for c in ("node", "component"))
            arrays = [np.concatenate(found).view(np.int64), node[each], component[each], size[each]]
            names = ["k", "node", "component", "size", "bits"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(bits, pa.binary())], names=names)

    return scan


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs in each group that are of different components and whose sizes and parities allow the similarity."""
    names = ["a", "b", "ca", "cb"]
    for table, starts in whole_groups(batches, ["k", "_i", "_j"]):
        node, component, size, block = (table.column(c).to_numpy() for c in ("node", "component", "size", "_b"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        n = len(node)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        at, step = np.arange(n), 1
        a, b, held = [], [], 0
        while len(at := at[at + step < ends[at]]):
            here = at[(component[at] != component[at + step]) & (~cross[at] | (block[at] != block[at + step]))]
            small, large = np.minimum(size[here], size[here + step]), np.maximum(size[here], size[here + step])
            here, both = here[ok := small >= DEDUP_SIMILARITY * large - 1e-6], (small + large)[ok]
            apart = np.bitwise_count(bits[here] ^ bits[here + step]).sum(axis=1, dtype=np.int64)
            here = here[apart <= both * (1 - DEDUP_SIMILARITY) / (1 + DEDUP_SIMILARITY) + 1e-6]
            a.append(here)
            b.append(here + step)
            held += len(here)
            step += 1
            if held > FOREST_PAIRS:
                x, y = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], component[x], component[y])], names=names)
                a, b, held = [], [], 0
        if held:
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], component[x], component[y])], names=names)


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [
            _similar(shingle_set(x.as_py() or b""), shingle_set(y.as_py() or b""))
            for x, y in zip(batch.column("body_a"), batch.column("body_b"))
        ]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def missed(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b``: links between the components of ``nodes(node, component)`` that connect all similar sets in different ones.

    Most prefixes have shingles of one component only, and are dropped before any set is met.
    """
    levels = nodes.sparkSession.sparkContext.broadcast(frequency_levels(bodies.select("body")))
    texts = nodes.join(bodies, F.col("node") == F.col("_uid")).select("node", "component", "body")
    rows = land(texts.mapInArrow(_prefixed(levels), "k long, node long, component long, size int, bits binary"), release=True)
    shared = rows.groupBy("k").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high")
    met = land(rows.select("k", "node", "component", "size").join(shared.select("k"), "k", "left_semi"), release=True)
    marks = rows.where("bits is not null").select("node", "bits")
    marks = land(marks.join(met.select("node").distinct(), "node", "left_semi"), release=True)
    pairs = blocked(met.join(marks, "node"), ["k"], "node", BLOCK).mapInArrow(_across, "a long, b long, ca long, cb long")
    ordered = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("ca", "cb", "ca"), ("cb", "ca", "cb"))]
    pairs = land(pairs.select(*ordered).distinct(), release=True)
    one = bodies.select(F.col("_uid").alias("a"), F.col("body").alias("body_a"))
    two = bodies.select(F.col("_uid").alias("b"), F.col("body").alias("body_b"))
    compared = pairs.join(one, "a").join(two, "b").select("ca", "cb", "body_a", "body_b").toDF("a", "b", "body_a", "body_b")
    return land(compared.mapInArrow(_similar_pairs, "a long, b long").distinct(), release=True, batch_rows=SET_ROWS)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with its smallest ``doc_id``.

    Groups are what links of similar sets connect; texts without words are alike.  Rows that
    share that id, or that have none, are told apart by their place in ``docs``; exactly one
    stays.
    """
    kept = [plain(c).alias(f"_col_{i}") for i, c in enumerate(docs.columns)]
    place = {c: f"_col_{i}" for i, c in enumerate(docs.columns)}
    base = land(docs.select(F.monotonically_increasing_id().alias("_uid"), *kept), release=True)
    body = F.col(place["text"]).cast("binary").alias("body")
    texts = base.select("_uid", F.col(place["doc_id"]).cast("long").alias("_id"), body)
    sketches = land(texts.mapInArrow(_sketched, "_uid long, _id long, _key binary, fp binary"))
    best = F.min(F.struct(F.col("_id").isNull().alias("_missing"), "_id", "_uid")).alias("_best")
    sets = land(sketches.groupBy("_key").agg(best, F.min("fp").alias("fp")).select(F.col("_best._uid").alias("node"), "_best", "fp"))
    found = components(similar_sets(sets, base.select("_uid", body)))
    roots = land(sets.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "_best"), release=True)
    more = missed(roots.select("node", "component"), base.select("_uid", body))
    if not more.isEmpty():
        wider = components(more).select(F.col("node").alias("component"), F.col("component").alias("_wider"))
        roots = roots.join(wider, "component", "left").select(F.coalesce("_wider", "component").alias("component"), "_best")
    stay = land(roots.groupBy("component").agg(F.min("_best").alias("_best")).select(F.col("_best._uid").alias("_of")))
    out = base.join(stay, F.col("_uid") == F.col("_of"), "left_semi")
    return out.select(*(F.col(f"_col_{i}").alias(c) for i, c in enumerate(docs.columns)))
