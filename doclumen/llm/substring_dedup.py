"""Removing long repeated substrings by run-length indexes (operator 3).

Every window of ``LENGTH`` bytes has an anchor: its least hash of ``ANCHOR`` bytes, the
leftmost of equal ones.  Equal windows have equal anchors, so windows can only match if
their anchor occurs in two different texts.  Hashes of anchors are counted first; stretches
of text around anchors that do recur are then sent, each distinct one once, to the bucket
of their anchor.

A bucket indexes its stretches by a run-length compressed Burrows-Wheeler transform.
Streaming a stretch backwards through it gives, at each step, the row of one more suffix
by the runs alone; rows with ``LENGTH`` or more bytes in common with their neighbours form
groups, sampled with the smallest document that has them.  A window is removed where that
document comes before its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import drop, id_order, land

LENGTH = 50
ANCHOR = 24
SPAN = LENGTH - ANCHOR + 1
#: Bytes of texts whose anchors are found together; texts whose anchors are counted together;
#: bytes of text for each bucket of anchors;
#: stretches of a bucket on average; stretches of one anchor beyond which windows are grouped singly.
TOGETHER = 1 << 16
TEXTS = 4096
BUCKET_BYTES = 1 << 25
BUCKET_STRETCHES = 40_000
MANY_STRETCHES = 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` (24) bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _C[4]
    held = None
    for k, step in enumerate((1, 2, 4, 8)):
        if step == 8:
            held = h
        h = h[:-step] * _C[k] + h[step:]
        h ^= h >> np.uint64(29)
    h = h[:-8] * _C[4] + held[16:]
    h ^= h >> np.uint64(32)
    h *= _C[1]
    return h ^ (h >> np.uint64(29))


def least_places(h: np.ndarray) -> np.ndarray:
    """For each window the place of the leftmost least of its ``SPAN`` (27) hashes."""
    least, at = h, np.arange(len(h), dtype=np.int32)
    for step in (1, 2, 4, 8):
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
    step = SPAN - 16
    return np.where(least[step:] < least[:-step], at[step:], at[:-step])


def stretches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Maximal runs of windows with one anchor, for some texts at a time.

    Yields the number of the first text, and for each run its text (counted from there),
    first and last window (in the joined bytes) and anchor hash; the joined bytes; and
    where each text starts in them.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= TOGETHER):
            size += len(texts[last])
            last += 1
        joined = b"".join(texts[first:last])
        lengths = np.array([len(t) for t in texts[first:last]])
        begins = np.cumsum(lengths) - lengths
        if len(joined) >= LENGTH:
            h = anchor_hashes(np.frombuffer(joined, np.uint8))
            at = least_places(h)
            owner = np.repeat(np.arange(last - first), lengths)[: len(at)]
            inside = np.flatnonzero(np.arange(len(at)) + LENGTH <= (begins + lengths)[owner])
            if len(inside):
                a, o = at[inside], owner[inside]
                new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])))
                ends = np.append(new[1:], len(inside)) - 1
                yield first, o[new], inside[new], inside[ends], h[a[new]], joined, begins
        first = last


def _keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _counted(buckets: int):
    """Anchors of a batch: for each bucket the hashes that one text of the batch has; hashes that
    several have are known to recur, and go with each of these texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            texts = [t.as_py() or b"" for t in batch.column(1)]
            names = batch.column(0).to_numpy()
            who, what = [], []
            for first, owner, _, _, h, _, _ in stretches(texts):
                who.append(owner + first)
                what.append(h)
            if not who:
                continue
            text, h = names[np.concatenate(who)], np.concatenate(what)
            order = np.lexsort((text, h))
            text, h = text[order], h[order]
            once = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
            text, h = text[once], h[once]
            new = np.append(True, h[1:] != h[:-1])
            sizes = np.diff(np.append(np.flatnonzero(new), len(h)))
            several = np.repeat(sizes > 1, sizes)
            out: dict[str, list] = {n: [] for n in ("bucket", "th", "recurring", "texts", "rems")}

            def tell(bucket, th, recurring, some, rems):
                for n, v in zip(out, (bucket, th, recurring, some, rems)):
                    out[n].append(v)

            mine, known = text[several], h[several]
            order = np.argsort(mine, kind="stable")
            mine, known = mine[order], known[order]
            begins = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else []
            for b, e in zip(begins, [*begins[1:], len(mine)] if len(mine) else []):
                tell(int(mine[b]) % buckets, int(mine[b]), known[b:e].tobytes(), None, None)
            # A hash that several texts have is sent once, with a mark in place of a text.
            keep = ~several | new
            bucket, rem = _keys(h[keep], buckets)
            text, mark = text[keep], several[keep]
            order = np.argsort(bucket, kind="stable")
            held = bucket[order]
            # Only buckets that occur: their number in all grows with the corpus.
            begins = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else []
            for b, e in zip(begins, [*begins[1:], len(held)] if len(held) else []):
                part = order[b:e]
                some, place = np.unique(text[part], return_inverse=True)
                place = np.where(mark[part], len(some), place).astype("<u2" if len(some) < 65_535 else "<u4")
                tell(int(held[b]), None, place.tobytes(), some.tobytes(), rem[part].tobytes())
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return each


def _recurring(buckets: int):
    """Of a bucket's hashes those that two texts have, by text; what is known to recur passes through."""

    def each(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        th, recurring = [], []
        rems, names, marks = [], [], []
        for row in table.select(["th", "recurring", "texts", "rems"]).to_pylist():
            if row["th"] is not None:
                th.append(row["th"])
                recurring.append(row["recurring"])
                continue
            of = np.append(np.frombuffer(row["texts"], np.int64), np.int64(0))
            rem = np.frombuffer(row["rems"], np.uint32)
            place = np.frombuffer(row["recurring"], f"<u{len(row['recurring']) // len(rem)}")
            rems.append(rem)
            names.append(of[place])
            marks.append(place == len(of) - 1)
        if rems:
            rem, text, mark = np.concatenate(rems), np.concatenate(names), np.concatenate(marks)
            order = np.argsort(rem, kind="stable")
            rem, text, mark = rem[order], text[order], mark[order]
            begins = np.flatnonzero(np.append(True, rem[1:] != rem[:-1]))
            sizes = np.diff(np.append(begins, len(rem)))
            low, high = np.minimum.reduceat(text, begins), np.maximum.reduceat(text, begins)
            found = np.repeat((low != high) | np.logical_or.reduceat(mark, begins), sizes) & ~mark
            text, rem = text[found], rem[found]
            order = np.argsort(text, kind="stable")
            text, rem = text[order], rem[order]
            # The upper half need only lead to the same bucket: it is compared with nothing else.
            begins = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
            for b, e in zip(begins, [*begins[1:], len(text)] if len(text) else []):
                th.append(int(text[b]))
                recurring.append(((np.uint64(bucket) << np.uint64(32)) | rem[b:e].astype(np.uint64)).tobytes())
        return pa.table({"th": pa.array(th, pa.int64()), "recurring": pa.array(recurring, pa.binary()), "bucket": pa.array([bucket] * len(th), pa.int64())})

    return each


def _around(buckets: int):
    """The stretches of each text whose anchor recurs, with the place of their first window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("body")]
            wanted = []
            for parts in batch.column("recurring"):
                raw = np.frombuffer(b"".join(p.as_py() for p in parts.values), np.uint64)
                bucket, rem = _keys(raw, buckets)
                wanted.append((bucket.astype(np.uint64) << np.uint64(32)) | rem)
            orders, names = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
            for first, owner, begin, end, h, joined, begins in stretches(texts):
                bucket, rem = _keys(h, buckets)
                # Keys of different texts are kept apart by mixing the text's number in.
                number = np.arange(len(begins), dtype=np.uint64) * _C[0]
                known = np.concatenate([w ^ k for w, k in zip(wanted[first : first + len(begins)], number)])
                key = (bucket.astype(np.uint64) << np.uint64(32)) | rem
                here = np.flatnonzero(np.isin(key ^ number[owner], known))
                if not len(here):
                    continue
                found = [joined[b:e] for b, e in zip(begin[here].tolist(), (end[here] + LENGTH).tolist())]
                text = first + owner[here]
                arrays = [
                    pa.array(orders[text]), pa.array(names[text]), pa.array(h[here].view(np.int64)),
                    pa.array(np.array([digest(s) for s in found], np.uint64).view(np.int64)), pa.array(found, pa.binary()),
                    pa.array((begin[here] - begins[owner[here]]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["ord", "th", "anchor", "h", "stretch", "start"])

    return each


def _by_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of small numbers, and a key of each pair in that order.

    Where a pair and its place fit into 64 bits they are sorted as one number, several times
    as fast as places by their keys.
    """
    shift, at = int(low.max()).bit_length(), len(low).bit_length()
    key = (high.astype(np.uint64) << np.uint64(shift)) | low.astype(np.uint64)
    if int(high.max()).bit_length() + shift + at > 64:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort((key << np.uint64(at)) | np.arange(len(low), dtype=np.uint64))
    return (both & np.uint64((1 << at) - 1)).astype(np.int64), both >> np.uint64(at)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, with the smallest document
    sampled for each group of rows that share ``LENGTH`` bytes."""

    def __init__(self, joined: np.ndarray, lengths: np.ndarray, documents: np.ndarray):
        strings = len(lengths)
        lengths = lengths.astype(np.int64) + 1
        ends = np.cumsum(lengths) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.uint64)
        within = np.ones(n, bool)
        within[ends] = False
        text[within] = joined.astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(strings), lengths)
        left = ends[owner] - np.arange(n)  # bytes from a place to the end of its string
        # Ranks by the first 7 bytes, then doubled; ends of strings differ by their number.
        padded = np.append(text, np.zeros(6, np.uint64))
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | np.where(left >= k, padded[k : k + n], np.uint64(0))
        rank, known, order = None, 7, np.argsort(key)
        ordered = key[order]
        while True:
            new = np.append(False, ordered[1:] != ordered[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if known == 28:
                by_28 = rank
            if known >= 28 and new[1:].all():
                break
            ahead = np.minimum(np.arange(n) + known, n - 1)
            # Equal ranks end within what is known all together or not at all.
            order, ordered = _by_pairs(rank, np.where(left >= known, rank[ahead], owner))
            known *= 2
        before = text[order - 1]
        before[left[order] == lengths[owner[order]] - 1] = 0  # nothing stands before a string
        head = np.append(True, before[1:] != before[:-1])
        self.run_starts = np.flatnonzero(head)
        self.run_bytes = before[self.run_starts].astype(np.int64)
        run_lengths = np.diff(np.append(self.run_starts, n))
        # Row of a run's first suffix one byte longer: runs of a byte follow each other in order.
        totals = np.bincount(text.astype(np.int64), minlength=258)
        self.run_rows = np.empty(len(run_lengths), np.int64)
        by_byte = np.argsort(self.run_bytes, kind="stable")
        laid = np.cumsum(run_lengths[by_byte]) - run_lengths[by_byte]
        firsts = np.cumsum(totals) - totals
        starts_of = np.cumsum(np.bincount(self.run_bytes, run_lengths, 258)) - np.bincount(self.run_bytes, run_lengths, 258)
        self.run_rows[by_byte] = firsts[self.run_bytes[by_byte]] + laid - starts_of[self.run_bytes[by_byte]].astype(np.int64)
        long = left[order] >= LENGTH
        tail = np.minimum(order + LENGTH - 28, n - 1)
        same = long[1:] & long[:-1] & (by_28[order[1:]] == by_28[order[:-1]]) & (by_28[tail[1:]] == by_28[tail[:-1]])
        group = np.append(True, ~same)
        self.group_document = np.minimum.reduceat(documents[owner[order]], np.flatnonzero(group))
        # The number of heads up to a row tells its run and its group without a search.
        self.run_of = np.cumsum(head, dtype=np.int32) - 1
        self.group_of = np.cumsum(group, dtype=np.int32) - 1
        self.lengths = lengths - 1

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All strings from their ends backwards in step: the strings still running, the place reached in
        each, and the row of the suffix there."""
        active = np.arange(len(self.lengths))
        row, place = active.copy(), self.lengths.copy()
        while True:
            running = place > 0
            active, row, place = active[running], row[running], place[running]
            if not len(active):
                return
            run = self.run_of[row]
            row = self.run_rows[run] + row - self.run_starts[run]
            place = place - 1
            yield active, place, row

    def smallest(self, row: np.ndarray) -> np.ndarray:
        """The smallest document that has the first ``LENGTH`` bytes of the suffix at ``row``."""
        return self.group_document[self.group_of[row]]


def _matched(table: pa.Table) -> pa.Table:
    """``windows``: bits of the windows of each stretch that an earlier document has too."""
    anchors = table.column("anchor").to_numpy()
    firsts = table.column("first").to_numpy()
    _, which, counts = np.unique(anchors, return_inverse=True, return_counts=True)
    windows: list[bytes | None] = [None] * len(anchors)
    shared = np.flatnonzero(counts[which] > 1)  # a stretch that has its anchor alone matches no other
    if len(shared):
        chosen = table.column("stretch").combine_chunks().take(pa.array(shared))
        _, offsets, data = chosen.buffers()
        offsets = np.frombuffer(offsets, np.int32)[chosen.offset : chosen.offset + len(chosen) + 1]
        lengths = np.diff(offsets)
        index = RunLengthIndex(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], lengths, firsts[shared])
        bits = np.zeros((len(shared), int(lengths.max()) - LENGTH + 1), bool)
        for active, place, row in index.stream():
            whole = index.lengths[active] - place >= LENGTH
            active, place, row = active[whole], place[whole], row[whole]
            bits[active, place] = index.smallest(row) < firsts[shared][active]
        for k in np.flatnonzero(bits.any(axis=1)).tolist():
            windows[int(shared[k])] = np.packbits(bits[k]).tobytes()
    return pa.table({"anchor": table.column("anchor"), "h": table.column("h"), "first": table.column("first"), "windows": pa.array(windows, pa.binary())})


def _singly(distinct: DataFrame) -> DataFrame:
    """The same as ``_matched`` for anchors with very many stretches: every window is grouped by its bytes."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("stretch") - LENGTH + 1), lambda i: F.substring("stretch", i, LENGTH)))
    each = distinct.select("anchor", "h", "first", at.alias("place", "window"))
    least = each.groupBy("window").agg(F.min("first").alias("least"))
    found = each.join(least, "window").groupBy("anchor", "h", "first").agg(
        F.array_sort(F.collect_list(F.when(F.col("least") < F.col("first"), F.col("place")))).alias("places")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for places in batch.column("places").to_pylist():
                bits = np.zeros(LENGTH, bool)
                bits[places] = True
                windows.append(np.packbits(bits).tobytes() if places else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(windows, pa.binary())], names=["anchor", "h", "first", "windows"])

    return found.mapInArrow(packed, "anchor long, h long, first long, windows binary")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed and remaining bytes of each text."""
    for batch in batches:
        kept, removed, spans = [], [], []
        marks = batch.column("marks")
        each = marks.flatten()
        start, size, windows = (each.field(n) for n in ("start", "n", "windows"))
        begins = np.asarray(start, np.int64)
        ends = begins + np.asarray(size, np.int64)
        partly = np.asarray(windows.is_valid(), bool)
        bounds = np.asarray(marks.offsets, np.int64) - int(marks.offsets[0].as_py())
        for text, lo, hi in zip(batch.column("body"), bounds[:-1].tolist(), bounds[1:].tolist()):
            data = np.frombuffer(text.as_py() or b"", np.uint8)
            whole = lo + np.flatnonzero(~partly[lo:hi])
            froms, tos = [begins[whole]], [ends[whole]]
            for k in (lo + np.flatnonzero(partly[lo:hi])).tolist():
                own = np.flatnonzero(np.unpackbits(np.frombuffer(windows[k].as_py(), np.uint8)))
                froms.append(begins[k] + own)
                tos.append(begins[k] + own + LENGTH)
            change = np.bincount(np.concatenate(froms), minlength=len(data) + 1) - np.bincount(np.concatenate(tos), minlength=len(data) + 1)
            gone = np.cumsum(change[:-1]) > 0
            kept.append(data[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        arrays = [batch.column("ord"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["ord", "th", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes over it also starts in a row with a smaller
    ``doc_id``.  Missing ids come after all others and not before each other; rows with
    the same id do not empty each other; a null text is empty and so is what is kept of it;
    texts shorter than ``LENGTH`` stay as they are.  Columns but ``doc_id`` and ``text`` are
    not read.
    """
    base, cleaned = _removals(docs)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    changed = cleaned.dropDuplicates(["ord", "th"])
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    rows = base.select("ord", "th", "copy", "n_bytes").distinct().join(changed, ["ord", "th"], "left")
    rows = rows.select(
        F.col("ord").alias("_ord"), F.col("th").alias("_th"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("_kept"),
    )
    order = id_order(F.col("doc_id").cast("long"))
    found = docs.select("doc_id", order.alias("_o"), F.xxhash64(body).alias("_t"), body.alias("_body"))
    out = found.join(rows, (F.col("_o") == F.col("_ord")) & (F.col("_t") == F.col("_th")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("_kept", "_body").alias("kept"))


def substring_digests(docs: DataFrame) -> DataFrame:
    """What ``substring_dedup`` does to every row, with ``kept_sha256`` in place of the bytes.

    Texts that lose nothing, or everything, are not read again for it.
    """
    base, cleaned = _removals(docs)
    changed = cleaned.select("ord", "th", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    changed = land(changed.dropDuplicates(["ord", "th"]), release=True)
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    return base.join(changed, ["ord", "th"], "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def _removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's ``doc_id, ord, th, n_bytes, sha, copy``, and ``ord, th, n_removed, n_spans, kept`` of
    those texts, other than copies, that lose bytes."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(id_order(F.col("doc_id").cast("long")).alias("ord"), F.xxhash64(body).alias("th"), body.alias("body"))
    base = land(
        docs.select(
            "doc_id", id_order(F.col("doc_id").cast("long")).alias("ord"), F.xxhash64(body).alias("th"),
            F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("sha"),
        )
    )
    firsts = land(base.groupBy("sha").agg(F.min("ord").alias("first")))
    base = land(base.join(firsts, "sha").withColumn("copy", F.col("ord") > F.col("first")).drop("first"))
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    counted = texts.filter(F.octet_length("body") >= LENGTH).select("th", "body").mapInArrow(
        _counted(buckets), "bucket long, th long, recurring binary, texts binary, rems binary"
    )
    found = counted.groupBy("bucket").applyInArrow(_recurring(buckets), "th long, recurring binary, bucket long")
    found = land(found.drop("bucket"), release=True, batch_rows=TEXTS)
    wanted = found.groupBy("th").agg(F.collect_list("recurring").alias("recurring"))
    owners = base.filter(~F.col("copy")).select("ord", "th").distinct()
    wanted = land(owners.join(wanted, "th"), release=True)
    # Rows alike in id order and text are no copies of each other; one stands for all of them.
    around = texts.join(wanted, ["ord", "th"]).dropDuplicates(["ord", "th"]).mapInArrow(
        _around(buckets), "ord long, th long, anchor long, h long, stretch binary, start int"
    )
    around = land(around, release=True)
    drop(found)
    drop(wanted)

    distinct = land(around.groupBy("anchor", "h", "stretch").agg(F.min("ord").alias("first")), release=True)
    many = land(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > MANY_STRETCHES).select("anchor"))
    groups = max(8, -(-distinct.count() // BUCKET_STRETCHES))
    usual = distinct.join(many, "anchor", "left_anti").withColumn("bucket", F.pmod("anchor", F.lit(groups)))
    schema = "anchor long, h long, first long, windows binary"
    matched = usual.groupBy("bucket").applyInArrow(_matched, schema)
    if many.limit(1).count():
        matched = matched.union(_singly(distinct.join(many, "anchor", "left_semi")))
    matched = land(matched, release=True)
    drop(distinct)

    own = F.when(F.col("ord") == F.col("first"), F.col("windows"))
    mark = F.struct("start", "n", own.alias("windows")).alias("mark")
    marks = around.select("ord", "th", "anchor", "h", "start", F.octet_length("stretch").alias("n")).join(matched, ["anchor", "h"])
    marks = marks.filter((F.col("ord") > F.col("first")) | F.col("windows").isNotNull()).select("ord", "th", mark)
    marks = land(marks.groupBy("ord", "th").agg(F.collect_list("mark").alias("marks")), release=True)
    drop(around)
    cleaned = texts.join(marks, ["ord", "th"]).dropDuplicates(["ord", "th"]).mapInArrow(_cleaned, "ord long, th long, n_removed long, n_spans long, kept binary")
    return base, cleaned
