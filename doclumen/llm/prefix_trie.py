"""The trie of conversations that share their first turns (operator 11).

Every conversation is a path from the root; equal beginnings are one node.  A beginning is
known by the exclusive or of hashes of its turns with their places, 128 bits together, so
that running values along a conversation can be cut anywhere and put together again: a
conversation with a third of all turns is spread over tasks like any other rows.

Totals of subtrees come from a centroid decomposition of the forest of parent edges.  The
centroid of a component is its deepest node with over half of the component's weight in its
subtree; the total below it goes to the nodes on its path up to the component's top, and
the component falls apart into what hangs below the centroid and the rest, each with at
most half of the weight.  Components too large for a task are split by Spark, all at
once in each round, so that rounds grow with the logarithm of the weight and not with the
depth; the others are split to the end in the task that holds them.

A node's weight is the number of its members, so the weight of a whole subtree is the
number of turns its members have left, which grouping the turns gives without the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import drop, land

#: Conversations ``c - c % FAMILY`` lend their first turns, fewer than ``LENT``.
FAMILY, LENT = 5, 9
#: Most nodes of a component that one task splits to the end.
TASK_NODES = 20_000
#: Bytes of listed ids that go to the task of their node as one row.
LISTED_BYTES = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, order: list[Column], xored: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``n``, the number of rows of ``key`` so far, and ``xored`` as running values.

    Rows are parted by ranges of key and order, so one key may go on over many tasks: each
    counts from nothing, and what earlier tasks have had of its first key is added after.
    Two rows for each partition reach the driver.
    """
    fields = [f for f in df.schema if f.name not in ("n", "_part", "_run")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n long, _part int, _run long"

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, run = TaskContext.get().partitionId(), None, -1
        before = [np.int64(0)] * (len(xored) + 1)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            runs = run + np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, np.arange(rows), -1))  # -1: goes on from the last batch
            held = {}
            for i, name in enumerate(xored):
                total = np.bitwise_xor.accumulate(batch.column(names.index(name)).to_numpy())
                till = np.where(start > 0, total[start - 1], 0)
                held[name] = total ^ np.where(start < 0, before[i], till)
            count = np.arange(1, rows + 1) - np.maximum(start, 0) + np.where(start < 0, before[-1], 0)
            before = [*(held[x][-1] for x in xored), count[-1]]
            last, run = keys[-1], int(runs[-1])
            arrays = [pa.array(held[c]) if c in held else batch.column(i) for i, c in enumerate(names)]
            arrays += [pa.array(count), pa.array(np.full(rows, part, np.int32)), pa.array(runs)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n", "_part", "_run"])

    by = [F.col(key), *order]
    ran = land(df.select(*names).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(along, schema))
    state = F.struct(key, "_run", "n", *xored)
    ends = ran.groupBy("_part").agg(
        F.max_by(state, F.struct("_run", "n")).alias("last"), F.max_by(state, F.when(F.col("_run") == 0, F.col("n"))).alias("first")
    )
    carried, held_key, held = [], None, [0] * (len(xored) + 1)
    for row in sorted(ends.collect()):
        first, last = row["first"], row["last"]
        goes_on = first[key] == held_key
        if goes_on:
            carried.append((row["_part"], *held))
        add = held if goes_on and last["_run"] == 0 else [0] * (len(xored) + 1)
        held_key, held = last[key], [last["n"] + add[0], *(last[x] ^ a for x, a in zip(xored, add[1:]))]
    more = ", ".join(f"_more_{x} long" for x in ("n", *xored))
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, f"_of int, {more}"))
    out = ran.join(carry, (F.col("_part") == F.col("_of")) & (F.col("_run") == 0), "left")
    new = {x: F.col(x).bitwiseXOR(F.coalesce(f"_more_{x}", F.lit(0).cast("long"))) for x in xored}
    new["n"] = F.col("n") + F.coalesce("_more_n", F.lit(0))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in [*names, "n"]))


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``conv, size, depth, bytes, x1, x2, p1, p2``: each rebuilt conversation's beginnings, from
    the empty one at depth 0 to the whole one at depth ``size``; ``x`` names a beginning and
    ``p`` the one that is a turn shorter."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    own = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    own = land(running(own, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")]).drop("turn"))
    sizes = own.groupBy("conv").agg(F.max("n").alias("turns"))
    base = F.col("conv") - F.col("conv") % FAMILY
    lent = F.crc32(F.col("conv").cast("string").cast("binary")) % LENT
    convs = sizes.withColumn("base", base).withColumn("lent", lent)
    of = sizes.select(F.col("conv").alias("base"), F.col("turns").alias("there"))
    taken = F.least("lent", F.coalesce("there", F.lit(0)))
    convs = convs.join(of, "base", "left").withColumn("taken", taken)
    convs = land(convs.withColumn("size", F.col("taken") + F.greatest(F.col("turns") - F.col("lent"), F.lit(0))))
    first = own.filter(F.col("n") < LENT).withColumnRenamed("conv", "base")
    place = ["conv", "size", "depth", "digest", "bytes"]
    borrowed = first.join(convs.select("conv", "base", "taken", "size"), "base").filter("n <= taken").withColumn("depth", F.col("n"))
    kept = own.join(convs.select("conv", "lent", "taken", "size"), "conv").filter("n > lent").withColumn("depth", F.col("taken") + F.col("n") - F.col("lent"))
    rows = borrowed.select(*place).unionByName(kept.select(*place))
    roots = convs.select("conv", "size", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    rows = rows.unionByName(roots)
    hashes = {"h1": F.xxhash64("digest", "depth"), "h2": F.xxhash64("depth", "digest")}
    rows = rows.withColumns({h: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(e) for h, e in hashes.items()})
    rows = rows.select("conv", "size", "depth", "bytes", "h1", "h2", F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    named = running(rows, "conv", [F.col("depth")], ("x1", "x2"))
    parents = {f"p{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)}
    return named.withColumns(parents).drop("h1", "h2", "n")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each node: names of it and its parent, members, children, own values."""
    own = rows.groupBy("depth", "x1", "x2").agg(
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("weight"),
        F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
    )
    own = land(own)
    below = own.filter("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    parents = own.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = own.join(children, ["depth", "x1", "x2"], "left").fillna(0, ["n_children"])
    root = F.col("depth") == 0
    key = {"p1": F.when(root, None).otherwise(F.col("p1")), "p2": F.when(root, None).otherwise(F.col("p2"))}
    return land(full.withColumns(key).join(parents, ["depth", "p1", "p2"], "left"))


def _split_once(active: DataFrame, large: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits each of the ``large`` components at its centroid.

    Returns the centroids, which are done, and the other nodes with new components.
    ``places`` (``conv, depth, at``) tells which node a conversation passes at a depth.
    """
    top = ["top_conv", "top_depth"]
    inside = active.join(large, top)
    heavy = inside.filter(2 * F.col("rem") > F.col("total"))
    centres = heavy.groupBy(*top).agg(F.max_by(F.struct("conv", "depth", "rem"), "depth").alias("z"))
    centres = land(centres.select(*top, F.col("z.conv").alias("z_conv"), F.col("z.depth").alias("z_depth"), F.col("z.rem").alias("z_rem")))
    inside = land(active.join(centres, top))
    # Which conversations go through the centroid, and through which of its children.
    deep = inside.filter("depth >= z_depth").select(*top, "conv", "z_conv", "z_depth").distinct()
    at = places.select("conv", F.col("depth").alias("z_depth"), F.col("at").alias("at_z"))
    child = places.select("conv", (F.col("depth") - 1).alias("z_depth"), F.col("at").alias("child"))
    through = deep.join(at, ["conv", "z_depth"]).filter("at_z = z_conv").join(child, ["conv", "z_depth"], "left")
    through = through.select(*top, "conv", "child", F.lit(True).alias("_through"))
    is_z = (F.col("conv") == F.col("z_conv")) & (F.col("depth") == F.col("z_depth"))
    under = F.coalesce(F.col("_through") & (F.col("depth") > F.col("z_depth")), F.lit(False))
    sided = land(inside.join(through, [*top, "conv"], "left").withColumns({"_is_z": is_z, "_under": under}).drop("_through"))
    totals = sided.filter("_is_z or _under").groupBy(*top).agg(F.sum("leaves").alias("z_leaves"), F.sum("saved").alias("z_saved"))
    totals = land(centres.join(totals, top))
    path = totals.join(places, (F.col("z_conv") == F.col("conv")) & (F.col("depth") < F.col("z_depth")) & (F.col("depth") >= F.col("top_depth")))
    path = path.select(*top, F.col("at").alias("conv"), "depth", "z_leaves", "z_saved", F.col("z_rem").alias("less"))
    done = sided.filter("_is_z").join(totals.select(*top, "z_leaves", "z_saved"), top)
    done = done.select("conv", "depth", (F.col("sum_leaves") + F.col("z_leaves")).alias("n_leaves"), (F.col("sum_saved") + F.col("z_saved")).alias("saved_tokens"))
    upper = sided.filter("not _is_z and not _under").join(path, [*top, "conv", "depth"], "left")
    upper = upper.fillna(0, ["z_leaves", "z_saved", "less"]).withColumns(
        {"rem": F.col("rem") - F.col("less"), "sum_leaves": F.col("sum_leaves") + F.col("z_leaves"), "sum_saved": F.col("sum_saved") + F.col("z_saved")}
    )
    lower = sided.filter("_under").withColumns({"top_conv": F.col("child"), "top_depth": F.col("z_depth") + 1})
    return land(done), land(upper.select(*active.columns).unionByName(lower.select(*active.columns)))


def subtree_totals(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Totals of ``values`` over the subtrees of a component, by its centroid decomposition.

    Node 0 is the top, parents stand before their children, ``weight`` is that of a node's
    subtree within the component.
    """
    children: list[list[int]] = [[] for _ in parent]
    for node in range(1, len(parent)):
        children[parent[node]].append(node)
    weight = list(weight)
    out = [[0] * len(parent) for _ in values]
    tops = [0]
    while tops:
        top = tops.pop()
        path, centre = [], top
        while True:
            heavy = next((c for c in children[centre] if 2 * weight[c] > weight[top]), None)
            if heavy is None:
                break
            path.append(centre)
            centre = heavy
        below = [centre]
        for node in below:
            below.extend(children[node])
        for own, sums in zip(values, out):
            total = sum(own[node] for node in below)
            sums[centre] += total
            for node in path:
                sums[node] += total
        if path:
            for node in path:
                weight[node] -= weight[centre]
            children[path[-1]].remove(centre)
            tops.append(top)
        tops.extend(children[centre])
        children[centre] = []
    return out


_ROLLED = ("conv", "depth", "n_leaves", "saved_tokens")


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits each component to the end; its nodes come together, by depth."""
    names = ("conv", "depth", "parent_conv", "rem", "leaves", "saved", "sum_leaves", "sum_saved", "top_conv", "top_depth")
    key, nodes, out = None, [], []

    def finish() -> None:
        place = {(n[0], n[1]): i for i, n in enumerate(nodes)}
        parent = [place.get((n[2], n[1] - 1), 0) for n in nodes]
        sums = subtree_totals(parent, [n[3] for n in nodes], [[n[4] for n in nodes], [n[5] for n in nodes]])
        out.extend((n[0], n[1], n[6] + a, n[7] + b) for n, a, b in zip(nodes, *sums))

    def shown() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * 4
        found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_ROLLED))
        out.clear()
        return found

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[8:] != key:
                if nodes:
                    finish()
                key, nodes = row[8:], []
            nodes.append(row)
        yield shown()
    if nodes:
        finish()
    yield shown()


def _rollup(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv, depth, n_leaves, saved_tokens`` for every node."""
    zero = F.lit(0).cast("long")
    root = nodes.agg(F.min("conv_id")).first()[0]
    active = nodes.select(
        F.col("conv_id").alias("conv"),
        "depth",
        F.col("parent_conv_id").alias("parent_conv"),
        F.col("weight").alias("rem"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        zero.alias("sum_leaves"),
        zero.alias("sum_saved"),
        F.lit(root).cast("long").alias("top_conv"),
        zero.alias("top_depth"),
    )
    active = land(active)  # else the first round's joins would have a literal for a key
    top = ["top_conv", "top_depth"]
    places, done, small = None, [], []
    while True:
        sizes = land(active.groupBy(*top).agg(F.count("*").alias("nodes"), F.max("rem").alias("total")))
        large = sizes.filter(F.col("nodes") > TASK_NODES).drop("nodes")
        if large.isEmpty():
            small.append(active)
            break
        if places is None:
            places = land(rows.select("conv", "depth", "x1", "x2").join(nodes.select("depth", "x1", "x2", F.col("conv_id").alias("at")), ["depth", "x1", "x2"]).select("conv", "depth", "at"))
        small.append(active.join(large.select(*top), top, "left_anti"))
        centres, active = _split_once(active, large, places)
        done.append(centres)
    left = small[0]
    for more in small[1:]:
        left = left.unionByName(more)
    left = left.repartition(*top).sortWithinPartitions(*top, "depth", "conv")
    out = left.mapInArrow(_roll, "conv long, depth long, n_leaves long, saved_tokens long")
    for centres in done:
        out = out.unionByName(centres)
    return out


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that end at a node, in order: some of them joined by commas in each row."""
    key, first, held, size = None, 0, [], 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal held, size
        if held:
            out.append((*key, first, ",".join(held)))
        held, size = [], 0

    for batch in batches:
        for at, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "conv"))):
            if (at, depth) != key or size >= LISTED_BYTES:
                close()
                key, first = (at, depth), conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield _listing(out)
    close()
    yield _listing(out)


def _listing(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    out.clear()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["at", "depth", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's whole list.  A digest has to read its list in order, but holds a row at a time."""
    key, state = None, None
    out: list[tuple] = []

    def shown() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["conv", "depth", "ends"])

    for batch in batches:
        for at, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "ids"))):
            if (at, depth) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (at, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield shown()
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield shown()


def _ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv, depth, ends`` for nodes at which members end."""
    named = nodes.select("depth", "x1", "x2", F.col("conv_id").alias("at"))
    members = rows.filter("depth = size").select("conv", "depth", "x1", "x2").join(named, ["depth", "x1", "x2"]).select("at", "depth", "conv")
    parts = members.repartitionByRange("at", "depth", "conv").sortWithinPartitions("at", "depth", "conv")
    parts = parts.mapInArrow(_listed, "at long, depth long, first long, ids string")
    whole = parts.repartition("at", "depth").sortWithinPartitions("at", "depth", "first")
    return whole.mapInArrow(_digested, "conv long, depth long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member) and ``depth`` name a node; ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` as the
    query's contract says.  Rows without ``conv_id`` belong to no conversation; a missing
    role or text is empty; turns without a number come first, and turns with equal numbers, repeated rows
    among them, follow each other by a digest of role and text; a conversation may be
    without turns once rebuilt and is then a member of the root alone; an empty table gives an
    empty result.  Other columns are not read.
    """
    rows = land(rebuilt_turns(conversations), release=True)
    nodes = _nodes(rows)
    sums = land(_rollup(nodes, rows), release=True).withColumnRenamed("conv", "conv_id")
    ends = land(_ends(rows, nodes)).withColumnRenamed("conv", "conv_id")
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
